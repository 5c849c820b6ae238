import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import Bounds, Invalid, Keys, OrderedFrame, Ordering, SortKey, asof_join, output_schema

MIN, MAX = -(1 << 63), (1 << 63) - 1


def frame(spark, rows, schema, **kw):
    rows = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, schema + ", n long")
    return OrderedFrame.implicit(df.repartition(3), by=["n"], **kw)


def dropped(f):
    return OrderedFrame(f.data.drop("n"), f.ordering)


def on_frame(spark, values, *more):
    schema = "on long" + "".join(f", {c}" for c in more)
    return dropped(frame(spark, values, schema))


def joined(out, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in out.sorted().collect()]


def test_payload_and_schema(spark):
    left = T.StructType([T.StructField("on", T.LongType(), False), T.StructField("key", T.LongType(), False), T.StructField("label", T.StringType(), False)])
    right = T.StructType([T.StructField("on", T.LongType(), False), T.StructField("key", T.LongType(), False), T.StructField("value", T.LongType(), False), T.StructField("list", T.ArrayType(T.LongType()), False)])
    a = OrderedFrame.implicit(spark.createDataFrame([(x, 1, "left") for x in (-1, 0, 2, 4)], left))
    b = OrderedFrame.implicit(spark.createDataFrame([(-2, 1, 10, [10, 11]), (0, 1, 20, [20]), (3, 1, 30, [30, 31])], right))
    keys = [Keys("on", ("key",))] * 2
    out = asof_join(a, b, keys, -2)
    assert joined(out, "value") == [10, 20, 20, 30]
    assert joined(out, "list") == [[10, 11], [20], [20], [30, 31]]
    assert out.columns == ["on", "key", "label", "value", "list"]
    schema = output_schema(a, [b], keys)
    assert [f.nullable for f in schema] == [False, False, False, True, True]


def test_null_keys_match_and_null_times_do_not(spark):
    left = dropped(frame(spark, [(1, None, "key"), (1, 1, "key"), (1, 2, "key"), (None, 1, "key")], "on long, key long, key2 string"))
    right = dropped(frame(spark, [(1, 2, "key", 200), (1, None, "key", 999), (1, 1, "key", 100), (None, 1, "key", 666)], "on long, key long, key2 string, value long"))
    out = asof_join(left, right, [Keys("on", ("key", "key2"))] * 2, 0)
    assert joined(out, "value") == [999, 100, 200, None]


@pytest.mark.parametrize(
    ("left", "right", "bounds", "want"),
    [
        ([10, 20, 30, 40], [8, 12, 18, 22, 30, 41], Bounds(-2, 2, True), [8, 18, 30, 41]),
        ([10, 20, 30, 40], [8, 12, 18, 22, 30, 41], Bounds(-2, 2, False), [12, 22, 30, 41]),
        ([0], [MIN], MIN, [MIN]),
        ([1, 1], [1, 1], 0, [1, 1]),
        ([], [], 1, []),
    ],
)
def test_tolerances(spark, left, right, bounds, want):
    out = asof_join(on_frame(spark, [(x,) for x in left]), on_frame(spark, [(x, x) for x in right], "value long"), [Keys("on")] * 2, bounds)
    assert joined(out, "value") == want


def test_duplicates_last_at_zero_first_above(spark):
    left, right = on_frame(spark, [(1,), (1,)]), on_frame(spark, [(1, 10), (1, 20)], "value long")
    assert joined(asof_join(left, right, [Keys("on")] * 2, 0), "value") == [20, 20]
    assert joined(asof_join(left, right, [Keys("on")] * 2, 1), "value") == [10, 10]


@pytest.mark.parametrize("tol", [-10, -(10**10)])
def test_tolerance_is_inclusive(spark, tol):
    left = dropped(frame(spark, [(0, 0), (0, 1)], "on long, key long"))
    right = dropped(frame(spark, [(tol - 1, 1, 99), (tol, 0, 42)], "on long, key long, value long"))
    assert joined(asof_join(left, right, [Keys("on", ("key",))] * 2, tol), "value") == [42, None]


def brute(left, right, b, keyed):
    out = []
    for t, k in left:
        best = None
        if t is not None and MIN <= t + b.upper and t + b.lower <= MAX:
            can = [(rt, i) for i, (rt, rk) in enumerate(right) if rt is not None and (not keyed or rk == k) and b.lower <= rt - t <= b.upper]
            if can and b.upper <= 0:
                best = max(can)[1]
            elif can:
                ahead = min((c for c in can if c[0] >= t), default=None)
                past = max((c for c in can if c[0] < t), default=None)
                if ahead and past and ahead[0] != t:
                    d = (t - past[0]) - (ahead[0] - t)
                    best = past[1] if d < 0 or d == 0 and b.prefer_earlier_on_tie else ahead[1]
                else:
                    best = (ahead or past)[1]
        out.append(best)
    return out


SETTINGS = [Bounds(-6, -2), Bounds(2, 5), Bounds(-4, 4), Bounds(-4, 4, False), Bounds(-3, 0), Bounds(0, 3), Bounds(0, 0), Bounds(-2, 6, False), Bounds(MIN, 0), Bounds(MIN, MAX), Bounds(1, MAX), Bounds(MIN, -1)]


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("buckets", [1, 7])
def test_matches_brute_force(spark, keyed, buckets):
    rng = random.Random(f"{keyed}{buckets}")

    def rows(n):
        times = sorted(rng.choice([rng.randrange(40), rng.randrange(40), MIN, MAX, MIN + 3]) for _ in range(n))
        mixed = [(t if rng.random() > 0.1 else None, rng.choice([None, 1, 2])) for t in times]
        return mixed

    left, rights = rows(60), [rows(50), rows(40)]
    l_frame = dropped(frame(spark, left, "on long, key long"))
    r_frames = [dropped(frame(spark, [(t, k, i) for i, (t, k) in enumerate(r)], f"on long, key long, v{j} long")) for j, r in enumerate(rights)]
    if not keyed:
        r_frames = [OrderedFrame(f.data.drop("key"), f.ordering) for f in r_frames]
    keys = [Keys("on", ("key",) if keyed else ())] * 3
    for b in SETTINGS:
        out = asof_join(l_frame, r_frames, keys, b, validate="off", buckets=buckets)
        got = joined(out, "v0", "v1")
        assert got == list(zip(*(brute(left, r, b, keyed) for r in rights), strict=True)), b


def test_types_of_times(spark):
    for kind, unit in (("byte", 1), ("short", 1), ("int", 1), ("date", 1), ("timestamp", 1_000_000), ("timestamp_ntz", 1_000_000)):
        made = spark.range(5).select((F.timestamp_seconds("id") if "timestamp" in kind else F.expr("date_from_unix_date(int(id))") if kind == "date" else F.col("id")).cast(kind).alias("on"), "id")
        left = OrderedFrame(OrderedFrame.implicit(made, by=["id"]).data.drop("id"), Ordering.implicit())
        right = OrderedFrame.implicit(made.withColumnRenamed("id", "v").filter("v % 2 = 0"), by=["v"])
        assert joined(asof_join(left, right, [Keys("on")] * 2, -1 * unit), "v") == [0, 0, 2, 2, 4]
    unsigned = spark.range(3).select((F.col("id") + F.lit(1 << 62)).cast("decimal(20,0)").alias("on"), "id")
    f = OrderedFrame.implicit(unsigned, by=["id"])
    assert joined(asof_join(OrderedFrame(f.data.drop("id"), f.ordering), f, [Keys("on")] * 2, 0), "id") == [0, 1, 2]


def test_contract(spark):
    good, bad = on_frame(spark, [(0,), (1,)]), on_frame(spark, [(1,), (0,)])
    keys = [Keys("on")] * 2
    other = OrderedFrame(good.data.withColumn("v", F.lit(1)), good.ordering)
    for left, right in ((bad, other), (good, OrderedFrame(bad.data.withColumn("v", F.lit(1)), bad.ordering))):
        with pytest.raises(Invalid):
            asof_join(left, right, keys, 1)
    with pytest.raises(Invalid):
        asof_join(OrderedFrame.unordered(good.df), other, keys, 1)
    with pytest.raises(Invalid):
        Bounds(1, -1)
    with pytest.raises(Invalid):
        asof_join(good, [], keys[:1], 1)
    with pytest.raises(Invalid):
        asof_join(good, other, [Keys("on"), Keys("missing")], 1)
    with pytest.raises(Invalid):
        asof_join(good, other, [Keys("on"), Keys("on", ("v",))], 1)
    with pytest.raises(Invalid):
        asof_join(OrderedFrame(good.data.withColumn("on", F.col("on").cast("double")), good.ordering), other, keys, 1)
    with pytest.raises(Invalid):
        asof_join(OrderedFrame(good.data.withColumn("on", F.col("on").cast("int")), good.ordering), other, keys, 1)
    with pytest.raises(Invalid):
        asof_join(OrderedFrame(good.data, Ordering.explicit(SortKey("on", False))), other, keys, 1)
    for values, nulls in (([0, None], "first"), ([None, 0], "last")):
        f = on_frame(spark, [(v,) for v in values])
        with pytest.raises(Invalid):
            asof_join(OrderedFrame(f.data, Ordering.explicit("on", nulls=nulls)), other, keys, 1)


def test_repeated_names_need_suffixes(spark):
    f = dropped(frame(spark, [(0, 1), (1, 2)], "on long, secondary long"))
    with pytest.raises(Invalid):
        asof_join(f, f, [Keys("on")] * 2, 0)
    out = asof_join(f, f, [Keys("on")] * 2, 0, suffixes=["_r"])
    assert joined(out, "secondary", "secondary_r") == [(1, 1), (2, 2)]


def test_one_key_costs_no_square(spark):
    """A frame that shrinks from row to row would take minutes here."""
    import time

    n = 60_000
    rows = spark.range(2 * n).select(F.col("id").alias("on"), F.lit(1).alias("k"), F.col("id").alias("v"))
    left = OrderedFrame.implicit(rows.filter("id % 2 = 0").drop("v"), by=["on"])
    right = OrderedFrame.implicit(rows.filter("id % 2 = 1"), by=["on"])
    keys = [Keys("on", ("k",))] * 2
    began = time.time()
    row = asof_join(left, right, keys, Bounds(0, 1), validate="off").df.agg(F.count("v"), F.sum(F.col("v") - F.col("on"))).first()
    assert tuple(row) == (n, n) and time.time() - began < 60
    hot = asof_join(left, right, keys, Bounds(0, 1), validate="off", hot_rows=10_000).df
    assert tuple(hot.agg(F.count("v"), F.sum(F.col("v") - F.col("on"))).first()) == (n, n)
    assert "bucket" in hot._jdf.queryExecution().toString()
