import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def coin(i, text, seed=0):
    return int(md5(f"{seed}:{'null' if i is None else i}:{'null' if text is None else md5(text)}")[:13], 16) / 2**52


def brute_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Share, clamp, and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    target = dict.fromkeys(names, 0.0)
    left, active = share * sum(sizes.values()), set(names)
    while left > 1e-9 and active:
        total = sum(w[s] for s in active)
        for s in active:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(active):
            if target[s] >= cap[s]:
                left += target[s] - cap[s]
                target[s] = cap[s]
                active.remove(s)
    return target


def brute(docs):
    size = {k: len(WORD.findall(t or "")) for k, (_, t, _) in enumerate(docs)}
    sources = {}
    for k, (_, _, s) in enumerate(docs):
        sources[s] = sources.get(s, 0) + size[k]
    target = brute_targets(sources)
    out = []
    for k, (i, text, s) in enumerate(docs):
        rate = target[s] / sources[s] if sources[s] else 0.0
        n = math.floor(rate) + (coin(i, text) < rate - math.floor(rate))
        out.append((i, size[k], sources[s], target[s], size[k] * n, n))
    return out


DOCS = [(i, "w " * (i * 7 % 50), f"s{i % 4}") for i in range(200)] + [(1000 + i, "big text here " * 40, "hot") for i in range(80)]
DOCS += [(5000, None, "s1"), (5001, "", None), (5002, "a\xa0b c", None), (None, "x y z", "Z"), (7, "w " * 49, "s3"), (7, "w " * 49, "s3"), (5003, "", "empty"), (5004, " \x0b", "é"), (5005, "q", "\U0001f600")]


def test_report_matches_brute_force(spark):
    df = spark.createDataFrame([(*d, k) for k, d in enumerate(DOCS)], "doc_id long, text string, source string, rate long")
    got = sorted(map(tuple, mixing.mix_report(df).collect()), key=lambda r: (str(r[0]), r[1:3]))
    want = sorted(brute(DOCS), key=lambda r: (str(r[0]), r[1:3]))
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-12) and g[4:] == w[4:]
    again = sorted(map(tuple, mixing.mix_report(df.repartition(7)).collect()), key=lambda r: (str(r[0]), r[1:3]))
    assert again == got


def test_mix_emits_the_reported_copies(spark):
    df = spark.createDataFrame([(*d, k, k) for k, d in enumerate(DOCS)], "doc_id long, text string, source string, copy long, _copies long")
    rows = mixing.mix(df).collect()
    assert mixing.mix(df).columns == [*df.columns, "copy_"]
    n = {}
    for r in rows:
        n.setdefault(r["copy"], []).append(r["copy_"])
    want = {k: w[5] for k, w in enumerate(brute(DOCS))}
    assert {k: sorted(v) for k, v in n.items()} == {k: list(range(1, c + 1)) for k, c in want.items() if c}


def test_long_source_lists_are_joined_without_broadcast(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("size", mixing.word_count(F.col("text")))
    targets, drawn = mixing.source_targets(df, "source", "size"), mixing.coin(F.col("doc_id"), F.col("text"))
    a = mixing.with_copies(df, targets, "source", drawn, "copies").select("doc_id", "copies")
    b = mixing.with_copies(df, targets, "source", drawn, "copies", broadcast_sources=2).select("doc_id", "copies")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_many_sources_keep_code_point_order(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('s', cast(id as string)) AS source", "cast(id % 13 as long) AS size")
    got = {r.source: r.weight for r in mixing.source_targets(df.repartition(9), "source", "size").collect()}
    assert got == {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(got))} and len(got) == 3000


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mix_report(df).count() == 0


def test_sources_without_ids_or_with_one_id_come_near_their_targets(spark):
    rows = [(None, f"word{k} again", "a") for k in range(3000)] + [(7, f"word{k} other", "b") for k in range(3000)]
    rows += [(k, "x y", "c") for k in range(3000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    by = got.groupBy(F.when(F.col("id") == -1, "a").when((F.col("id") == 7) & (F.col("size") == 2), "b").otherwise("c").alias("s"))
    for r in by.agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.08), r
