import math

import numpy as np
import pytest

from millrace.llm import ann


def brute(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], np.float64)
    norm = np.sqrt((m * m).sum(axis=1))
    out = {}
    for i, v in queries:
        q = np.array(v, np.float64)
        s = (m * q).sum(axis=1) / (norm * np.sqrt((q * q).sum()))
        order = [x for x in np.lexsort((ids, -s)) if ids[x] != i][:k]
        out[i] = [(int(ids[x]), float(s[x])) for x in order]
    return out


@pytest.mark.parametrize("shard_rows", [6000, 150])
def test_recall_on_the_embeddings(spark, shard_rows):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    got = {}
    for r in ann.search(ann.build_index(table, shard_rows=shard_rows), table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        exact = dict(want[q])
        hits += sum(f[1] in exact for f in found)
        assert all(f[2] == pytest.approx(exact[f[1]], abs=1e-12) for f in found if f[1] in exact)
    assert hits / (5 * len(want)) >= 0.95


def test_flat_arrays_round_trip():
    rng = np.random.default_rng(1)
    v = ann._unit(rng.normal(size=(300, 8)))
    graph = ann.Graph(v, 8, 40)
    again = ann.Graph.load(v, graph.flat(), 8)
    for q in v[:40]:
        assert graph.search(q.astype(np.float32), 5, 60) == again.search(q.astype(np.float32), 5, 60)


def test_edge_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 2), (1, [1.0, 0.0], 3), (1, [1.0, 0.0], 4), (2, [0.0, 1.0], 5), (3, [0.0, 0.0], 6), (50, None, 7), (150, [nan, 1.0], 8), (4, [inf, 1.0], 9), (200, [], 10), (5, [1.0, None], 11), (None, [1.0, 1.0], 12), (250, [1.0, 2.0, 3.0], 13), (6, [-0.0, 2.0], 14)]
    rows += [(1000 + 2 * i + 1, [1.0, 0.0], 15) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long")
    got = {}
    for r in ann.search(ann.build_index(df), df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert {k: sorted(v) for k, v in got.items()} == {
        0: [(1, 1, 1.0), (2, 100, 1.0), (3, 1001, 1.0), (4, 1003, 1.0), (5, 1005, 1.0)],
        100: [(1, 0, 1.0), (2, 1, 1.0), (3, 1001, 1.0), (4, 1003, 1.0), (5, 1005, 1.0)],
    }
    assert ann.search(ann.build_index(df.limit(0)), df.limit(0)).count() == 0


def test_tiny_and_huge_vectors_take_part(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 6))
    scale = np.ones((400, 1))
    scale[[3, 50, 100]], scale[[7, 51, 150]] = 1e-200, 1e200
    vectors = base * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, [5e-324] + [0.0] * 5)], "vec_id long, embedding array<double>")
    rows = ann.search(ann.build_index(df, shard_rows=150), df.filter("vec_id % 50 = 0")).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    unit = np.vstack([unit, [1, 0, 0, 0, 0, 0]])
    hits = 0
    for i in range(0, 401, 50):
        own = sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)
        cosine = unit @ unit[i]
        cosine[i] = -2
        want = np.argsort(-cosine)[:5].tolist()
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - cosine[r.vec_id]) < 1e-9 for r in own)
        hits += len(set(want) & {r.vec_id for r in own})
    assert hits >= 43


def test_one_id_with_two_vectors_asks_twice(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id long, embedding array<double>")
    rows = ann.search(ann.build_index(df), df.filter("vec_id = 0"), k=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 1), (0, 1, 2)]


def test_many_vectors_of_the_queries_own_id_hide_nobody(spark):
    df = spark.createDataFrame([(0, [1.0, k / 1000]) for k in range(60)] + [(1, [1.0, 0.2]), (2, [0.2, 1.0])], "vec_id long, embedding array<double>")
    rows = ann.search(ann.build_index(df), df.filter("vec_id = 0"), k=2).collect()
    assert len(rows) == 120 and {r.vec_id for r in rows if r.rank == 1} == {1}
