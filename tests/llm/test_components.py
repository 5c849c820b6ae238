import random

from pyspark.sql import functions as F

from millrace.llm.components import connected_components, joined_components


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in list(up)}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_paths_stars_cycles_and_repeats(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, 2), (2, 1), (3, 3), (1, 2)] + [(200, x) for x in range(201, 400)] + [(50, 51), (51, 52), (52, 50)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    got = {r.node: r.root for r in connected_components(frame(spark, [*edges, (None, 7), (8, None)]), "a", "b").collect()}
    assert got == brute(edges)
    assert connected_components(frame(spark, []), "a", "b").count() == 0


def test_further_edges_give_what_all_edges_give(spark):
    rng = random.Random(5)
    parts = [[(rng.randrange(300), rng.randrange(300)) for _ in range(n)] for n in (90, 40, 60, 0)]
    roots = connected_components(frame(spark, parts[0]), "a", "b").withColumnRenamed("node", "x")
    for k in range(1, len(parts)):
        roots = joined_components(roots, frame(spark, parts[k]), "x", "a", "b")
        rows = roots.select("x", F.col("root")).collect()
        got = {r.x: r.root for r in rows}
        want = brute([e for p in parts[: k + 1] for e in p])
        assert len(rows) == len(got)
        assert {x: r for x, r in want.items() if r != x} == {x: r for x, r in got.items() if r != x}
