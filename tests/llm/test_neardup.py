import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from millrace.llm import neardup
from millrace.llm.common import Scratch
from millrace.llm.components import connected_components

from .test_simhash import MASK, brute_components

LETTERS = "abcdefghij"


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(docs):
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def corpus(rng):
    docs = [(1, None), (2, ""), (3, "One"), (4, "one "), (5, "a b c d"), (6, "A b\tc d"), (7, "a b c d e"), (8, "é b c d e")]
    for _ in range(12):
        base = [rng.choice(LETTERS) + str(rng.randrange(300)) for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
            docs.append((len(docs) + 1, " ".join(words)))
    return docs


def test_shingles_match_definition():
    docs = corpus(random.Random(1))
    got = [value[a:b] for value, head in neardup.shingles(pa.array([t for _, t in docs])) for a, b in zip(head[:-1], head[1:], strict=True)]
    names = {}
    for g, (_, t) in zip(got, docs, strict=True):
        assert len(g) == len(shingles(t))
        names.setdefault(frozenset(shingles(t)), set()).add(g.tobytes())
    assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)


def test_stage_drops_every_near_copy(spark, tmp_path):
    docs = corpus(random.Random(2))
    df = spark.createDataFrame(docs + docs[20:22] + [(None, "one")], "doc_id long, text string")
    want = brute(docs)
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path)).collect()]
    kept = sorted(i for i, r in want.items() if i == r)
    assert sorted(got, key=str) == sorted([*kept, None], key=str) and 20 < len(kept) < 130
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(df.filter("doc_id IS NOT NULL")).collect()}
    assert found == want


def test_links_come_through_the_trie(spark, tmp_path, monkeypatch):
    import xxhash

    docs = [d for d in corpus(random.Random(4)) if shingles(d[1])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs]), pa.array([0] * len(docs))], names=["doc_id", "text", "h"])
    (signs,) = neardup._signatures(iter([batch]))
    want = {}
    for (_, t), cls, fp in zip(docs, signs.column("cls").to_pylist(), signs.column("fp").to_pylist(), strict=True):
        words = t.encode().lower().split()
        k = min(5, len(words))
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
        assert fp & MASK == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        want.setdefault(cls, fp & MASK)
    df = spark.createDataFrame(sorted((c, f - (1 << 64) if f >> 63 else f) for c, f in want.items()), "cls long, fp long")
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in connected_components(neardup.trie_pairs(df, scratch), "a", "b").collect()}
    root = brute_components(want)
    assert {c: got.get(c, c) for c in want} == root and len(set(root.values())) < len(want)
    seen, trie = [], neardup.hamming_forest
    monkeypatch.setattr(neardup, "hamming_forest", lambda *a: seen.append(a[2]) or trie(*a))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path)).count() == len(set(brute(docs).values()))
    assert seen == [3]


def test_texts_that_share_an_id_are_judged_one_by_one(spark, tmp_path):
    base, other = [" ".join(f"{w}{k}" for k in range(60)) for w in "ab"]
    near = base.replace("a59", "changed")
    # 3 has a text of its own and a near copy of 1; 5 has two near copies of each other
    docs = [(1, base), (3, near), (3, "its own words are here and nowhere else"), (5, other), (5, other + " more"), (9, other)]
    df = spark.createDataFrame(docs + docs[2:3], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path)).collect())
    assert got[:2] == [docs[0], docs[2]] and got[2:] in ([docs[3]], [docs[4]])


def test_candidates_of_other_components_are_compared():
    # key 1: components 5, 5 and 9; key 2: one component; key 3: sizes too different
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2, 2, 3, 3]), pa.array([5, 5, 9, 5, 5, 5, 7]), pa.array([5, 6, 9, 5, 6, 5, 7]), pa.array([10, 10, 9, 10, 10, 10, 2]), *[pa.array([0] * 7)] * len(neardup.SIGNS)], names=["key", "root", "cls", "n", *neardup.SIGNS])
    for rows in (1, 100):
        got = sorted(tuple(r.values()) for b in neardup._apart(iter([batch.slice(0, 2), batch.slice(2)]), True, rows) for r in b.to_pylist())
        assert got == [(5, 9), (6, 9)]
    far = batch.set_column(4, "s0", pa.array([-1, 0, 0, 0, 0, 0, 0])).set_column(5, "s1", pa.array([-1, 0, 0, 0, 0, 0, 0]))
    assert [tuple(r.values()) for b in neardup._apart(iter([far]), True) for r in b.to_pylist()] == [(6, 9)]
    odd = batch.set_column(8, "s4", pa.array([0, 0, 0, 0, 0, 0, 0])).set_column(9, "s5", pa.array([7, 0, 0, 0, 0, 0, 0]))
    assert [tuple(r.values()) for b in neardup._apart(iter([odd]), True) for r in b.to_pylist()] == [(6, 9)]
    near = batch.set_column(8, "s4", pa.array([1, 0, 0, 0, 0, 0, 0]))
    assert [tuple(r.values()) for b in neardup._apart(iter([near]), True) for r in b.to_pylist()] == [(5, 9), (6, 9)]
    assert neardup._nearest(np.array([4, 2, 4]), np.array([0.3, 0.1, 0.2])).tolist() == [1, 2]


def test_sketches_of_similar_sets_agree():
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 400]))]
        other = list(base)
        while True:
            last = list(other)
            other[rng.randrange(len(other))] = "x" + str(rng.randrange(10**6))
            a, b = shingles(" ".join(base)), shingles(" ".join(other))
            if 5 * len(a & b) < 4 * len(a | b):
                break
        texts += [" ".join(base), " ".join(last)]
    column = pa.array(texts)
    (batch,) = neardup._signatures(iter([pa.RecordBatch.from_arrays([pa.array(range(600)), column, pa.array(range(600))], names=["doc_id", "text", "h"])]))
    sketch = [batch.column(f"s{k}").to_numpy().view("uint64") for k in range(len(neardup.SIGNS))]
    left, right = np.arange(0, 600, 2), np.arange(1, 600, 2)
    assert neardup._alike(batch.column("n").to_numpy(), sketch, left, right)[0].all()
    assert neardup._alike(batch.column("n").to_numpy(), sketch, left, np.roll(right, 1))[0].sum() < 5
