import random

import numpy as np
import pytest

from millrace.llm import decontam

ALPHABET = "abcdefgh é"


def near_any(segments, text, budget):
    """Whether a segment (all of one length) is within the budget of any part of the text, by the full tables."""
    own = np.array([[ord(c) for c in s] for s in segments])
    ramp = np.arange(own.shape[1] + 1)
    row = np.repeat(ramp[None], len(own), 0)
    for c in text:
        new = row.copy()
        new[:, 0] = 0
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (own != ord(c)))
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        if row[:, -1].min() <= budget:
            return True
    return bool(row[:, -1].min() <= budget)


def brute(items, text, length=64, edits=4, least=24):
    """Every segment of every item by the full table; short items as whole words."""
    body, out = decontam.tidy(text), set()
    for item, t in items:
        b = decontam.tidy(t)
        if item is None or not b:
            continue
        if len(b) < least:
            if f" {b} " in f" {body} ":
                out.add(item)
            continue
        m = min(length, len(b))
        budget = min(edits, m * edits // length)
        segments = [b[at : at + m] for at in range(len(b) - m + 1)]
        # one of budget + 1 pieces of a match is exact: spares most tables
        segments = [s for s in segments if any(s[m * k // (budget + 1) : m * (k + 1) // (budget + 1)] in body for k in range(budget + 1))]
        if segments and near_any(segments, body, budget):
            out.add(item)
    return sorted(out)


def edited(rng, text, n):
    x = list(text)
    for _ in range(n):
        i = rng.randrange(len(x))
        kind = rng.randrange(3)
        if kind == 0:
            x[i] = rng.choice(ALPHABET)
        elif kind == 1:
            x.insert(i, rng.choice(ALPHABET))
        else:
            del x[i]
    return "".join(x)


def word_text(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_search_matches_the_full_table():
    rng = random.Random(2)
    items = [(i, word_text(rng, rng.choice([5, 9, 16, 40]))) for i in range(14)] + [(50, None), (None, "x" * 60), (51, "short"), (52, "")]
    items.append((90, items[3][1]))
    index = decontam.build(items)
    texts = []
    for k in range(60):
        body = word_text(rng, rng.randint(0, 40))
        if k % 4:
            leak = rng.choice(items[:14])[1]
            cut = leak[rng.randint(0, 20) :] if rng.random() < 0.4 else leak
            body += " " + edited(rng, cut, rng.choice([0, 1, 3, 4, 5, 9])).upper().replace(" ", "\n ") + rng.choice(["", " "]) + word_text(rng, rng.randint(0, 9))
        texts.append(body)
    got = decontam.search(index, [decontam.tidy(t) for t in texts])
    want = [brute(items, t) for t in texts]
    assert got == want
    assert sum(map(bool, want)) > 25 and not all(want)


@pytest.mark.parametrize("block_chars", [4_000_000, 60])
def test_frames(spark, block_chars):
    rng = random.Random(7)
    items = [(i, word_text(rng, 25)) for i in range(6)]
    docs = [(1, "x " + items[0][1] + " y", 1), (2, word_text(rng, 60), 2), (3, None, 3), (4, "", 4), (5, items[2][1] + items[5][1], 5), (5, items[2][1] + items[5][1], 6), (None, items[1][1], 7), (8, word_text(rng, 9000) + items[4][1], 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, items long")
    bench = spark.createDataFrame(items + [(77, None), (None, "y" * 50)], "item_id long, text string")
    kept = decontam.decontaminate(df, bench, block_chars=block_chars)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [d for d in docs if d[2] in (2, 3, 4)]
    assert decontam.decontaminate(df, bench.limit(0)).count() == 8
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    found = {r["row"].c2: r["items"] for r in decontam.contamination(df, bench, block_chars=block_chars).collect()}
    assert {k: v for k, v in found.items() if v} == {1: [0], 5: [2, 5], 6: [2, 5], 7: [1], 8: [4]}


def test_finds_every_whole_item_in_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    bench = {r.item_id: decontam.tidy(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: decontam.tidy(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: set(r["items"]) for r in decontam.op5(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        exact = {i for i, b in bench.items() if b in text}
        assert exact <= got[d] and bool(exact) == bool(got[d])


def test_excerpts_are_found_wherever_they_begin(spark):
    rng = random.Random(11)
    item = word_text(rng, 60)
    body = decontam.tidy(item)
    docs = [(at, "zz " + body[at : at + 64] + " zz") for at in range(len(body) - 63) if body[at] != " " != body[at + 63]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert len(docs) > 100 and decontam.decontaminate(df, bench).count() == 0


def test_every_start_matches_the_full_table():
    rng = random.Random(12)
    items = [(i, word_text(rng, n)) for i, n in enumerate([6, 14, 22, 30])]
    index = decontam.build(items)
    texts = []
    for k in range(40):
        leak = decontam.tidy(items[k % 4][1])
        at = rng.randint(0, max(0, len(leak) - 64))
        texts.append(word_text(rng, 3) + " " + edited(rng, leak[at : at + rng.choice([58, 62, 66])], rng.choice([0, 2, 4, 6])) + " " + word_text(rng, 3))
    want = [brute(items, t) for t in texts]
    assert decontam.search(index, [decontam.tidy(t) for t in texts]) == want
    assert 10 < sum(map(bool, want)) < 40


def test_neighbouring_texts_do_not_meet():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    index = decontam.build([(1, item)])
    body = decontam.tidy(item)
    a, b = body[:32], body[32:64]
    assert decontam.search(index, [a]) == decontam.search(index, [b]) == [[]]
    assert decontam.search(index, ["zzzz " + a, b + " yyyy"]) == [[], []]
    assert decontam.search(index, ["zzzz " + a, "", "", "", "", "", b + " yyyy", body[:64]]) == [[]] * 7 + [[1]]


def test_edits_are_characters():
    item = "съешь же ещё этих мягких французских булок"
    assert decontam.search(decontam.build([(1, item)]), ["да выпей " + item.replace("ь", "q", 1).replace("щ", "w", 1) + " чаю"]) == [[1]]
    assert decontam.search(decontam.build([(1, item)]), ["да выпей " + item.replace("е", "q", 4) + " чаю"]) == [[]]


def test_short_items_are_found_exactly_as_words():
    index = decontam.build([(1, "What is the  capital?"), (2, "é"), (3, "what is"), (4, ""), (5, None)])
    assert index.owners and decontam.search(index, [decontam.tidy(t) for t in ["so, WHAT is the capital?", "what is the capital", "whats is the capital? é", "xé", "", "é"]]) == [[1, 3], [3], [2], [], [], [2]]


def test_shared_beginnings_match_the_full_table():
    rng = random.Random(21)
    line = word_text(rng, 30)
    items = [(i, line + " " + word_text(rng, 12)) for i in range(12)] + [(20 + i, line[40:] + " " + word_text(rng, 2)) for i in range(4)] + [(40, line)]
    index = decontam.build(items)
    tidied = decontam.tidy(line)
    texts = [line, tidied[-70:] + " " + word_text(rng, 4), tidied[-45:] + " " + word_text(rng, 9), word_text(rng, 9) + " " + items[3][1][-80:], edited(rng, items[5][1], 3), tidied[:66]]
    texts += [word_text(rng, 3) + " " + edited(rng, decontam.tidy(rng.choice(items)[1])[a : a + 75], rng.choice([0, 3, 6])) for a in range(0, 120, 9)]
    texts = [decontam.tidy(t) for t in texts]
    want = [brute(items, t) for t in texts]
    assert decontam.search(index, texts) == want
    assert [decontam.search(index, [t])[0] for t in texts] == want
    assert {len(w) for w in want} >= {0, 1, 17}


def test_a_common_line_costs_no_square():
    import time

    rng = random.Random(22)
    line = word_text(rng, 40)
    index = decontam.build([(i, line + " " + word_text(rng, 12)) for i in range(4001)])
    texts = [decontam.tidy(word_text(rng, 40) + " " + line + " " + word_text(rng, 40)) for _ in range(4)] + [decontam.tidy(word_text(rng, 150_000))]
    began = time.time()
    got = decontam.search(index, texts)
    assert [len(x) for x in got] == [4001] * 4 + [0] and time.time() - began < 4


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(23)
    items = [(i, word_text(rng, 15)) for i in range(5)] + [(9, "a short one")]
    text = decontam.tidy(" ".join(word_text(rng, rng.randint(0, 40)) + " " + rng.choice(items)[1] for _ in range(30)))
    monkeypatch.setattr(decontam, "_PIECE", 300)
    index = decontam.build(items)
    for cut in (text, text[:700], "x" * 500, items[9 - 4][1]):
        pieces = list(decontam._cuts(cut, 70 + 24))
        assert sorted({i for p in decontam.search(index, pieces) for i in p}) == decontam.search(index, [cut])[0] == brute(items, cut)


def test_op5_keeps_every_row_over_several_blocks(spark, tmp_path):
    rng = random.Random(13)
    items = [(i, word_text(rng, 25)) for i in range(4)]
    docs = [(None, items[1][1]), (None, word_text(rng, 40)), (None, None), (5, items[2][1] + " " + items[0][1]), (5, word_text(rng, 40)), (6, ""), (7, items[3][1]), (7, items[3][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = [(None, True, [1]), (None, False, []), (None, False, []), (5, True, [0, 2]), (5, False, []), (6, False, []), (7, True, [3]), (7, True, [3])]
    for block_chars in (4_000_000, 150):
        got = [tuple(r) for r in decontam.op5(spark, str(tmp_path), block_chars=block_chars).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
