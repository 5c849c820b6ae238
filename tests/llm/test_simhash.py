import random

import numpy as np
import pytest
import xxhash

from millrace.llm import components, simhash

MASK = (1 << 64) - 1


def brute_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


TEXTS = [None, "", " \n ", "One", "one two", "one two three", "ONE TWO\tTHREE", "one two three four", "é É ü x y z", "a b c " * 400, "a b c " * 400, "a b c " * 399 + "d"]


def test_fingerprint_matches_definition():
    for t in TEXTS:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


def test_trie_links_match_all_pairs():
    rng = random.Random(5)
    for _ in range(30):
        base = [rng.getrandbits(64) for _ in range(4)]
        vals = set()
        for _ in range(rng.choice([3, 60, 300])):
            v = rng.choice(base)
            for _ in range(rng.randint(0, 6)):
                v ^= 1 << rng.randrange(64)
            vals.add(v)
        arr = np.array(sorted(vals), np.uint64)
        label = simhash.trie_links(arr, np.zeros(len(arr), np.int64), 3, chunk=rng.choice([8, 1 << 18]))
        want = brute_components({i: int(v) for i, v in enumerate(arr)})
        assert {i: int(x) for i, x in enumerate(label)} == want


def _corpus(rng):
    vocab = [f"w{i}" for i in range(300)]
    docs, base = [], []
    for _ in range(25):
        base.append([rng.choice(vocab) for _ in range(rng.choice([5, 80, 300]))])
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((i * 3 + 1, " ".join(words)))
    return docs + [(1000 + i, t) for i, t in enumerate(TEXTS)]


@pytest.mark.parametrize("max_subtree", [50_000, 8])
def test_near_duplicates_match_brute_force(spark, max_subtree):
    docs = _corpus(random.Random(3))
    df = spark.createDataFrame(docs + docs[:5] + [(None, "one")], "doc_id long, text string")
    got = simhash.near_duplicates(df, max_subtree=max_subtree).collect()
    assert len(got) == len(docs) + 6
    fps = {i: brute_fingerprint(t) for i, t in docs}
    want = brute_components(fps)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & MASK, r.component_id) == (fps[r.doc_id], want[r.doc_id])
        else:
            assert r.component_id == want[1003]  # the text "One" has its fingerprint


def test_drop_keeps_one_of_each_and_ignores_clashing_columns(spark):
    docs = [(1, "a b c d", 9), (2, "a b c d", 8), (2, "a b c d", 8), (7, None, 7), (5, "", 6), (None, "x", 5), (11, "zz yy xx ww", 4), (11, "zz yy xx ww", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, component_id long").withColumnRenamed("component_id", "fp")
    got = sorted(map(tuple, simhash.drop_near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, "a b c d", 9), (5, "", 6), (None, "x", 5), (11, "zz yy xx ww", 4)], key=repr)
    empty = simhash.drop_near_duplicates(df.limit(0))
    assert empty.columns == df.columns and empty.count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 200)]
    random.Random(1).shuffle(path)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(path, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200}
