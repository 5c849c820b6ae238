import json
import random

import numpy as np
import pytest

from millrace.llm import wordpiece as wp


def greedy(vocabulary, word):
    """Pieces by trying every length, longest first."""
    ends = any(w[-1] >= wp.END for w in vocabulary.first)
    rest = (*word[:-1], word[-1] + wp.END * ends)
    pieces, n = set(vocabulary.first), 0
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not k:
            return 1
        rest, n = rest[k:], n + 1
        pieces = set(vocabulary.later if vocabulary.later is not None else vocabulary.first)
    return n


def counts(vocabulary, words):
    data = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    return wp.count(wp.build(vocabulary), data, stop - [len(w) for w in words], stop).tolist()


@pytest.mark.parametrize("kind", ["prefix", "end", "plain"])
def test_counts_match_greedy_search(kind):
    rng = random.Random(kind)
    for _ in range(60):
        strings = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 14))}
        if kind == "prefix":
            v = wp.Vocabulary.prefixed([("##" if rng.random() < 0.5 else "") + s for s in strings])
        elif kind == "end":
            v = wp.Vocabulary(sorted({(*s.encode()[:-1], s.encode()[-1] + wp.END * (rng.random() < 0.4)) for s in strings}))
        else:
            v = wp.Vocabulary(sorted(tuple(s.encode()) for s in strings))
        words = [bytes(rng.choice(b"abc" if rng.random() < 0.97 else b"abcd") for _ in range(rng.randint(1, 12))) for _ in range(40)]
        assert counts(v, words) == [greedy(v, w) for w in words]


def test_public_vocabulary_on_documents(spark):
    v = wp.Vocabulary.marked_end(wp.VOCABULARY)
    assert len(v.first) > 49_000
    pieces, longest = set(v.first), max(map(len, v.first))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in wp.op7(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count()
    for r in docs.orderBy("doc_id").limit(40).collect():
        total = 0
        for word in r.text.lower().encode().split():
            rest = (*word[:-1], word[-1] + wp.END)
            while rest:
                k = next(k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in pieces)
                rest, total = rest[k:], total + 1
        assert got[r.doc_id] == total


def test_edge_cases(spark, tmp_path):
    docs = [(1, None, 1), (2, "", 2), (3, " \n", 3), (4, "ab abc", 4), (4, "ab abc", 5), (None, "AB", 6), (7, "ab" * 30_000, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens long")
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"added_tokens": [{"content": "<x>"}], "model": {"vocab": {"<x>": 0, "a": 1, "b": 2, "ab": 3, "ab</w>": 4}}}))
    rows = wp.token_counts(df, str(path)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in rows) == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, 2), (4, 2, 2), (7, 1, 30_000)]
    assert wp.token_counts(df.limit(0), wp.Vocabulary([])).count() == 0
    assert {r.n_tokens for r in wp.token_counts(df, wp.Vocabulary([])).collect()} == {0, 1, 2}
