import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import substrings
from millrace.llm.wordhash import Words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, width=50):
    """id -> (n, removed, kept) by looking up every window's words."""
    seq = [(i, SPLIT.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in seq:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in seq:
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(rng, width):
    vocab = ["a", "b"] + [f"w{i}é" for i in range(60)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([width - 1, width, width + 9, 3 * width]))] for _ in range(5)]
    passages += [["a"] * (2 * width), ["a", "b"] * width, (["x", "y", "z", "u", "v"] * width)[: 2 * width]]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(0, width))]
        docs.append((i * 2 + 1, rng.choice([" ", "\n", "\t  "]).join(words)))
    docs += [(500, docs[7][1]), (501, docs[7][1]), (499, docs[7][1] + " tail"), (501, docs[7][1]), (3, docs[20][1]), (600, None), (601, ""), (602, " \x0b\x0c ")]
    docs += [(None, docs[7][1]), (603, "a\xa0b " * (3 * width)), (604, "a\xa0b " * (3 * width))]
    return docs


@pytest.mark.parametrize(("width", "caps", "seed"), [(50, substrings.CAPS, 1), (12, (1, 1, 2), 2), (20, (1, 1, 2, 2), 4), (12, (1, 2), 3)])
def test_matches_brute_force(spark, width, caps, seed):
    docs = corpus(random.Random(seed), width)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, marks long").repartition(5)
    rows = substrings.without_repeats(df, width=width, caps=caps).collect()
    got = {r["row"].c2: (r["row"].c0, r.n_words, r.n_removed, r.kept) for r in rows}
    assert [got[k] for k in range(len(docs))] == brute(docs, width)


def test_interior_blocks_agree_in_equal_windows():
    rng = random.Random(9)
    shared = [rng.choice("abcdefgh") for _ in range(50)]
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] + shared + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(40)]
    found = set()
    for t in texts:
        data = np.frombuffer(" ".join(t).encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]))
        parsed = substrings.Parsed(words.hash, words.first)
        k = next(i for i in range(len(t)) if t[i : i + 50] == shared)
        found.add(int(parsed.symbol[parsed.unit[k]]))
    assert len(found) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.without_repeats(df).collect() == []


def test_words_match_a_regex():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é \n\t\x0b\x85\xa0") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    blob = b"".join(t.encode() for t in texts)
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    words = Words(np.frombuffer(blob, np.uint8), bounds)
    assert [blob[a:b].decode() for a, b in zip(words.start, words.stop)] == [w for t in texts for w in SPLIT.findall(t)]
    assert list(np.diff(words.first)) == [len(SPLIT.findall(t)) for t in texts]
    assert len(set(zip(words.hash.tolist(), (blob[a:b] for a, b in zip(words.start, words.stop))))) == len(set(words.hash.tolist()))


def test_digest_is_over_kept_words(spark, tmp_path):
    spark.createDataFrame([(1, " a  b\nc ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = substrings.op6(spark, str(tmp_path)).first()
    assert tuple(row) == (1, 3, 0, hashlib.sha256(b"a b c").hexdigest())


def test_drop_repeats_changes_only_what_it_cuts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, long, 0, "k"), (2, "x  y\n" + long + " z", 5, None), (3, " a  b ", 6, "row"), (4, None, None, None), (5, long, 9, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, kept string")
    got = sorted(map(tuple, substrings.drop_repeats(df, n_chars="n_chars").collect()))
    assert got == [docs[0], (2, "x y z", 5, None), docs[2], docs[3], (5, "", 0, "c")]
