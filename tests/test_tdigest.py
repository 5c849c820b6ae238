import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import Invalid
from millrace.functions import tdigest as td
from millrace.plans import queries

K0 = td.Options(delta=5, scaler="K0")


def values(spark, xs, kind="double"):
    return spark.createDataFrame([(x if x is None else float(x),) for x in xs], "v double").select(F.col("v").cast(kind).alias("v")).coalesce(1)


def flat(d):
    return [(c["mean"], c["weight"]) for c in d["centroids"]], d["min"], d["max"]


def test_map_reduce_quantile(spark):
    one = td.digest_map(values(spark, [1, 2, 3, 4, 5, 6]), [], "v", K0)
    assert flat(one.first()[0]) == ([(1.5, 2), (3.5, 2), (5.5, 2)], 1, 6)
    three = one.union(one).union(one)
    assert flat(td.digest_reduce(three, [], "digest", K0).first()[0]) == ([(1.5, 6), (3.5, 6), (5.5, 6)], 1, 6)
    q = td.Options(q=(0, 0.5, 1), delta=128, min_count=6, scaler="K0")
    assert td.quantile(one, [], "digest", q).first()[0] == [1, 3.5, 6]
    assert [r[0] for r in td.quantile_elementwise(three, "digest", "q", q).select("q").collect()] == [[1, 3.5, 6]] * 3


def test_empty_and_null(spark):
    blank = td.digest_map(values(spark, []), [], "v")
    assert flat(blank.first()[0]) == ([], None, None)
    q = td.Options(q=(0, 0.5, 1))
    assert td.quantile_elementwise(blank, "digest", "q", q).first().q == [None] * 3
    null = spark.range(1).select(F.lit(None).cast(td.DIGEST).alias("digest"))
    assert td.quantile_elementwise(null, "digest", "q", q).first().q is None
    assert td.digest_reduce(null, [], "digest").first()[0] is None
    assert td.quantile(null, [], "digest", q).first()[0] == [None] * 3
    some = values(spark, [1.0, float("nan"), None])
    assert td.tdigest(some, [], "v", td.Options(min_count=2)).first()[0] == [None]
    assert td.approximate_median(some, [], "v", min_count=2).first()[0] is None
    assert td.approximate_median(some, [], "v").first()[0] == 1.0
    strict = td.digest_map(some, [], "v", td.Options(skip_nulls=False))
    assert strict.first()[0] is None and td.digest_reduce(strict.union(strict), [], "digest").first()[0] is None


def test_errors(spark):
    for bad in ({"q": (-0.1,)}, {"q": (1.5,)}, {"q": (float("nan"),)}, {"delta": 0}, {"buffer_size": 0}, {"scaler": "K9"}):
        with pytest.raises(Invalid):
            td.Options(**bad)
    wrong = spark.createDataFrame([(([(1.0, -1.0)], 1.0, 1.0),)], "digest " + td.DIGEST.simpleString())
    with pytest.raises(Exception, match="weights"):
        td.digest_reduce(wrong, [], "digest").collect()
    with pytest.raises(NotImplementedError):
        td.tdigest(spark.createDataFrame([("a",)], "v string"), [], "v")
    with pytest.raises(Invalid):
        td.digest_reduce(values(spark, [1]), [], "v")


@pytest.mark.parametrize("kind", ["byte", "short", "int", "long", "float", "double", "decimal(10,2)", "decimal(38,2)"])
def test_types(spark, kind):
    made = td.digest_map(values(spark, [1, 2, 3, 4], kind), [], "v")
    assert td.quantile(made, [], "digest", td.Options(q=(0, 0.5, 1))).first()[0] == [1, 2.5, 4]


def test_equal_values_and_options(spark):
    o = td.Options(q=(0, 0.5, 1), min_count=8, scaler="K0")
    assert td.tdigest(values(spark, [3.0] * 8), [], "v", o).first()[0] == [3, 3, 3]
    assert td.Options.from_json(o.to_json()) == o
    with pytest.raises(Invalid):
        td.Options.from_json('{"version": 2}')


@pytest.mark.parametrize("scaler", ["K0", "K1"])
def test_rank_error_of_many_partials(spark, scaler):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=20_000), rng.exponential(size=20_000)])
    df = spark.createDataFrame([(float(v), i % 3 if i % 7 else None) for i, v in enumerate(x)], "v double, k int").repartition(16)
    qs = (0.01, 0.1, 0.5, 0.9, 0.99)
    found = {r.k: r.quantiles for r in td.tdigest(df, ["k"], "v", td.Options(q=qs, scaler=scaler)).collect()}
    assert set(found) == {0, 1, 2, None}
    for k, qv in found.items():
        own = np.array([v for i, v in enumerate(x) if (i % 3 if i % 7 else None) == k])
        for q, v in zip(qs, qv, strict=True):
            assert abs((own <= v).mean() - q) < 0.01
    total = sum(c["weight"] for r in td.digest_map(df, ["k"], "v").collect() for c in r.digest["centroids"])
    assert total == len(x)


def settled(x, q):
    """A quantile of single values, by a digest's rule."""
    x, at = sorted(x), q * len(x)
    if at <= 1 or at >= len(x) - 1:
        return x[0] if at <= 1 else x[-1]
    return (x[int(at) - 1] + x[int(at)]) / 2 if at == int(at) else x[math.ceil(at) - 1]


@pytest.mark.parametrize("name", ["tdigest_median", "tdigest_of_digests", "tdigest_reduced", "tdigest_small_groups"])
def test_queries_of_larger_groups_are_exact(spark, tmp_path, name):
    rng = random.Random(3)
    nations = [[round(rng.uniform(-999, 9999), 2) for _ in range(n)] for n in (1, 2, 3, 40, 240, 241, 3000)] + [[5.5] * 700 + [7.25] * 700]
    rows = [(i, v) for i, nation in enumerate(nations) for v in nation]
    spark.createDataFrame([(k, i, v) for k, (i, v) in enumerate(rows)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    fields = ["median"] if name == "tdigest_median" else ["low", "quarter", "middle", "upper", "high"]
    qs = [0.5] if name == "tdigest_median" else [0, 0.25, 0.5, 0.75, 1]
    found = {r.s_nationkey: [r[f] for f in fields] for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert found == {i: [settled(nation, q) for q in qs] for i, nation in enumerate(nations)}


def test_refined_by_any_digest(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), rng.gauss(0, 1), float(rng.randrange(3))])) for _ in range(6000)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    o = td.Options(q=(0.0, 0.001, 0.1, 0.5, 0.99, 1.0), min_count=10)
    own = {k: [v for n, v in data if n == k and v is not None and not math.isnan(v)] for k in ("a", "b", None)}
    want = {k: [settled(x, q) for q in o.q] for k, x in own.items()}
    misplaced = df.withColumn("v", F.col("v") * 100 - 7)
    for digests in (td.digest_map(df, ["k"], "v"), td.digest_map(misplaced, ["k"], "v", td.Options(delta=3))):
        assert {r.k: r.quantiles for r in td.refined(digests, ["k"], df, "v", o).collect()} == want
    everything = [v for x in own.values() for v in x]
    assert td.tdigest(df, [], "v", o, exact=True).first()[0] == [settled(everything, q) for q in o.q]
    assert td.tdigest(df, [], "v", td.Options(min_count=6001), exact=True).first()[0] == [None]
    assert td.tdigest(df, [], "v", td.Options(skip_nulls=False), exact=True).first()[0] == [None]
    assert td.approximate_median(df.filter("false"), [], "v", exact=True).first()[0] is None
    assert td.tdigest(df, ["k"], "v", td.Options(q=()), exact=True).first().quantiles == []
