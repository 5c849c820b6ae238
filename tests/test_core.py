import dataclasses
import random
from typing import Optional

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace import Agg, Declaration, Invalid, OrderedFrame, Ordering, Template
from millrace.ordering import chunked, numbered
from millrace.streaming import push


def table(spark, count, size):
    rows = spark.range(count).select((F.col("id") / size).cast("long").alias("segment"), F.col("id").alias("key"), F.col("id").alias("value"))
    return OrderedFrame(OrderedFrame.implicit(rows.repartition(6), by=["key"]).data, Ordering.implicit())


def test_scan_filter_sum(spark, tmp_path):
    spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "value long").write.parquet(str(tmp_path / "t"))
    plan = Declaration.sequence(
        Declaration("scan", {"spark": spark, "path": str(tmp_path / "t")}),
        Declaration("filter", {"predicate": F.col("value") > 2}),
        Declaration("aggregate", {"aggregates": [Agg("sum", "value", "total")]}),
    )
    assert [r.total for r in plan.frame().df.collect()] == [7]


@pytest.mark.parametrize("refine", ["track", "physical"])
def test_filter(spark, refine):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3), (4, 4)], "x long, y long").withMetadata("x", {"origin": "test"})
    f = OrderedFrame.implicit(df)
    out = m.filter_rows(f, F.col("x") > 0, ["x", "y"], refine)
    assert [tuple(r) for r in out.sorted().collect()] == [(3, 3), (4, 4)]
    assert [c.nullable for c in out.schema] == [False, False] and out.schema["x"].metadata == {"origin": "test"} or refine == "physical"
    if refine == "physical":
        assert not any(c.nullable for c in out.df.schema)
    assert m.filter_rows(f, True).df.count() == 4 and m.filter_rows(f, None).df.count() == 0
    with pytest.raises(KeyError):
        m.filter_rows(f, True, ["missing"])
    with pytest.raises(TypeError):
        m.filter_rows(f, F.col("x") + 1)


def test_pivot(spark):
    f = OrderedFrame.unordered(spark.createDataFrame([(1, 10), (2, 20)], "a long, b long"))
    u = "decimal(20,0)"
    ts = [Template([F.lit(1).cast(u)], ["a"]), Template([F.lit(2).cast(u)], ["b"]), Template([F.lit(None).cast(u)], [None])]
    out = m.pivot_longer(f, ts, ["kind"], ["measurement"])
    assert out.columns == ["a", "b", "kind", "measurement"] and not out.ordering.ordered
    rows = out.df.collect()
    assert len(rows) == 6 and sum(r.kind is None for r in rows) == 2 and sum(r.measurement is None for r in rows) == 2
    assert sorted(r.measurement for r in rows if r.kind == 2) == [10, 20]
    for bad in ([], [Template([None], ["a"])], [Template([F.lit(1)], ["a"]), Template([F.lit("x")], ["a"])], [Template([F.lit(1)], [None])], [Template([], ["a"])]):
        with pytest.raises(Invalid):
            m.pivot_longer(f, bad, ["kind"], ["measurement"])
    with pytest.raises(NotImplementedError):
        m.pivot_longer(f, [Template([F.lit(1)], ["a.b"])], ["kind"], ["measurement"])


def test_sources(spark):
    schema = pa.schema([("x", pa.int64())])
    batch = pa.RecordBatch.from_pydict({"x": [1, 2, 3, 4]}, schema)
    for flag, kind in ((True, "implicit"), (False, "unordered")):
        f = m.reader_source(spark, pa.RecordBatchReader.from_batches(schema, [batch, batch]), implicit_ordering=flag)
        assert f.ordering.kind == kind and f.df.count() == 8
        if flag:
            assert [r.x for r in f.sorted().collect()] == [1, 2, 3, 4, 1, 2, 3, 4]
    assert m.reader_source(spark, pa.RecordBatchReader.from_batches(schema, [batch])).ordering.kind == "unordered"
    with pytest.raises(Invalid):
        m.reader_source(spark, None)
    one = pa.RecordBatch.from_pydict({"x": [1, 2, 3]}, schema)
    made = [m.record_batch_source(spark, schema, lambda: iter([one])), m.exec_batch_source(spark, schema, [([[1, 2, 3]], 3)]), m.array_vector_source(spark, schema, [[[1, 2, 3]]]), m.table_source(spark, pa.Table.from_batches([one])), m.source(spark, schema, [one], "implicit")]
    for f in made:
        assert [r.x for r in f.sorted().collect()] == [1, 2, 3]
    assert [r.x for r in m.exec_batch_source(spark, schema, [([7], 4)]).sorted().collect()] == [7] * 4

    def failing():
        yield one
        raise Invalid("broken")

    for bad in (lambda: m.record_batch_source(spark, schema, failing), lambda: m.table_source(spark, None), lambda: m.table_source(spark, pa.table({"x": [1]}), 0), lambda: m.record_batch_source(spark, None, []), lambda: m.batch_source(spark, schema, [], False, object()), lambda: m.record_batch_source(spark, pa.schema([("y", pa.int64())]), [one]), lambda: m.array_vector_source(spark, schema, [[]])):
        with pytest.raises(Invalid):
            bad()
    with pytest.raises(NotImplementedError):
        m.table_source(spark, pa.table({"t": pa.array([1], pa.timestamp("ns"))}))
    wide = m.table_source(spark, pa.table({"u": pa.array([1 << 63], pa.uint64()), "d": pa.array(["a"]).dictionary_encode()}))
    assert [str(x) for x in wide.df.first()] == [str(1 << 63), "a"]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        df.write.format(kind).save(str(tmp_path / kind))
        got = m.scan(spark, str(tmp_path / kind), kind, schema="x long, s string").df
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b")]
    t = pa.table({"x": [1, 2]})
    for name, writer in (("f.arrow", pa.ipc.new_file), ("s.arrows", pa.ipc.new_stream)):
        with writer(str(tmp_path / name), t.schema) as w:
            w.write_table(t)
        assert m.scan(spark, str(tmp_path / name), "ipc").df.count() == 2
    with pytest.raises(Invalid):
        m.scan(spark, "x", "unknown")


def merge_input(spark, rows, nested):
    df = spark.createDataFrame([(on, p, nested[i], i) for i, (on, p) in enumerate(rows)], "on long, payload string, nested array<long>, i long")
    return OrderedFrame(OrderedFrame.implicit(df.repartition(2), by=["i"]).data.drop("i"), Ordering.implicit())


@pytest.mark.parametrize("nulls", ["first", "last"])
def test_sorted_merge(spark, nulls):
    left, right = [-4, 0], [-3, 1]
    left, right = ([None, *left], [None, *right]) if nulls == "first" else ([*left, None], [*right, None])
    nested = [[1, 2], [3], [4, 5]]
    frames = [merge_input(spark, [(x, n) for x in side], nested) for side, n in ((left, "left"), (right, "right"))]
    out = m.sorted_merge(frames, Ordering.explicit("on"), nulls)
    rows = out.sorted().collect()
    want = [-4, -3, 0, 1]
    assert [r.on for r in rows] == ([None, None, *want] if nulls == "first" else [*want, None, None])
    for r in rows:
        side = left if r.payload == "left" else right
        assert nested[side.index(r.on)] == r.nested
    assert out.schema.simpleString() == frames[0].schema.simpleString()


def test_merge_interleaves_and_rejects(spark):
    def one(values):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "on long, i long")
        return OrderedFrame(OrderedFrame.implicit(df, by=["i"]).data.drop("i"), Ordering.implicit())

    by = Ordering.explicit("on")
    out = m.sorted_merge([one(range(0, 128, 2)), one(range(1, 128, 2))], by)
    assert [r.on for r in out.sorted().collect()] == list(range(128))
    assert m.sorted_merge([one([])], by).df.count() == 0
    for bad in ([], [one([1, 0])], [OrderedFrame.unordered(one([1]).df)], [one([1]), merge_input(spark, [], [])]):
        with pytest.raises(Invalid):
            m.sorted_merge(bad, by)
    for values, nulls in (([0, None], "first"), ([None, 0], "last")):
        with pytest.raises(Invalid):
            m.sorted_merge([one(values)], by, nulls)
    with pytest.raises(Invalid):
        m.sorted_merge([one([1])], Ordering.implicit())
    with pytest.raises(Invalid):
        m.sorted_merge([one([1])], Ordering.explicit("missing"))
    with pytest.raises(NotImplementedError):
        m.sorted_merge([one([1])], Ordering.explicit(m.SortKey("on", False)))


def test_aggregate_shapes(spark):
    f = table(spark, 65541, 65541)
    out = m.aggregate(f, [Agg("hash_sum", "value", "sum")], ["key"], ["segment"])
    assert out.columns == ["segment", "key", "sum"]
    rows = out.sorted().collect()
    assert len(rows) == 65541 and all(r["sum"] == r.key for r in rows) and [r.key for r in rows] == list(range(65541))
    out = m.aggregate(table(spark, 2049, 113), [Agg("first", "value", "a"), Agg("last", "value", "b")], segment_keys=["segment"])
    assert [tuple(r) for r in out.sorted().collect()] == [(i, 113 * i, min(2048, 113 * (i + 1) - 1)) for i in range(19)]
    assert [r[0] for r in m.aggregate(f, [Agg("sum", "value", "s")]).df.collect()] == [65541 * 65540 // 2]
    none = table(spark, 0, 1)
    assert m.aggregate(none, [Agg("sum", "value", "s")]).df.count() == 1
    assert m.aggregate(none, [Agg("sum", "value", "s")], segment_keys=["segment"]).df.count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_segments_match_a_loop(spark, seed):
    import random

    rng = random.Random(seed)
    values = [rng.choice(["a", "a", "b", None]) for _ in range(300)]
    df = spark.createDataFrame([(v, i * rng.choice([1]) + 10) for i, v in enumerate(values)], "k string, i long")
    f = OrderedFrame.implicit(df.repartition(5), by=["i"])
    runs = []
    for i, v in enumerate(values):
        if not i or values[i - 1] != v:
            runs.append([v, 0])
        runs[-1][1] += 1
    out = m.aggregate(f, [Agg("count_all", None, "n")], segment_keys=["k"])
    assert [tuple(r) for r in out.sorted().collect()] == [tuple(r) for r in runs]
    by_text = OrderedFrame.implicit(df.withColumn("t", F.lpad(F.col("i").cast("string"), 9, "0")), by=["t"])
    assert m.aggregate(by_text, [Agg("count_all", None, "n")], segment_keys=["k"]).df.count() == len(runs)


def test_aggregate_functions_and_errors(spark):
    df = spark.createDataFrame([(1, None, True, 0), (1, 2.0, False, 1), (2, 4.0, True, 2)], "k long, v double, b boolean, i long")
    f = OrderedFrame.implicit(df, by=["i"])
    aggs = [Agg("first", "v", "f1"), Agg("first", "v", "f2", {"skip_nulls": False}), Agg("count", "v", "c"), Agg("count", "v", "cn", {"mode": "only_null"}), Agg("any", "b", "any"), Agg("all", "b", "all"), Agg("tdigest", "v", "q", {"q": [0.0, 1.0]}), Agg("approximate_median", "v", "med"), Agg("mean", "v", "m"), Agg("variance", "v", "var"), Agg("product", "v", "p")]
    got = [tuple(r) for r in m.aggregate(f, aggs, ["k"]).sorted().collect()]
    assert got == [(1, 2.0, None, 1, 1, True, False, [2.0, 2.0], 2.0, 2.0, 0.0, 2.0), (2, 4.0, 4.0, 1, 0, True, True, [4.0, 4.0], 4.0, 4.0, 0.0, 4.0)]
    assert m.aggregate(f, [Agg("tdigest", "v", "q"), Agg("sum", "v", "s")]).df.first() == ([2.0], 6.0)  # of two values the first is the lower median
    with pytest.raises(Invalid):
        m.aggregate(f, [], ["k"], ["k"])
    with pytest.raises(Invalid):
        m.aggregate(OrderedFrame.unordered(df), [Agg("first", "v", "f")])
    with pytest.raises(Invalid):
        m.aggregate(OrderedFrame.unordered(df), [], segment_keys=["k"])
    with pytest.raises(KeyError):
        m.aggregate(f, [Agg("unknown", "v", "f")])
    with pytest.raises(KeyError):
        m.aggregate(f, [], ["missing"])


def test_explicit_order_survives_segments(spark):
    f = table(spark, 20, 5)
    out = m.aggregate(OrderedFrame(f.data, Ordering.explicit("segment", "key")), [Agg("sum", "value", "s")], segment_keys=["segment"])
    assert out.ordering == Ordering.explicit("segment")


def test_pipes(spark):
    pipes = m.Pipes()
    f = pipes.tee(table(spark, 97, 97), "p")
    assert m.union(f, pipes.source("p")).df.count() == 194
    assert m.union(m.fetch(f, 0, 1), pipes.source("p")).df.count() == 98
    big = m.Pipes()
    big.sink(table(spark, 1025, 1025), "p")
    assert [big.source("p").df.count() for _ in range(2)] == [1025, 1025]
    with pytest.raises(Invalid):
        big.sink(f, "p")
    with pytest.raises(Invalid):
        big.source("missing")
    with pytest.raises(Invalid):
        big.source("p", schema=spark.range(1).schema)
    with pytest.raises(Invalid):
        big.source("p", ordering=Ordering.explicit("key"))
    assert not big.source("p", ordering=Ordering.unordered()).ordering.ordered
    with pytest.raises(NotImplementedError):
        big.sink(f, "q", stop_on_any=True)
    pipes.close()
    big.close()


def test_registry(spark):
    assert m.initialize() is m.initialize() and "asofjoin" in m.initialize().names()
    own = m.initialize(m.Registry())
    with pytest.raises(KeyError):
        own.add("filter", len)
    with pytest.raises(Invalid):
        own.add("other", None)
    with pytest.raises(KeyError):
        own.get("missing")
    assert "".join(own.names()) == "".join(sorted(own.names()))


@dataclasses.dataclass
class Centroid:
    mean: float
    weight: float


@dataclasses.dataclass
class Row:
    value: Optional[float]
    optional_list: list[Optional[float]]
    nested: tuple[list[float], list[float]]
    centroids: list[Centroid]


def test_rows_round_trip(spark):
    rows = [Row(1.0, [1.0, None, 3.0], ([1.0, 2.0], [3.0]), [Centroid(2.0, 3.0)]), Row(None, [], ([], []), []), Row(4.0, [None, 7.0], ([5.0], [6.0, 7.0]), [Centroid(1.0, 2.0), Centroid(4.0, 6.0)])]
    f = m.frame_from_rows(spark, rows, Row)
    assert [x.nullable for x in f.schema] == [True, False, False, False]
    assert f.schema["optional_list"].dataType.containsNull and not f.schema["centroids"].dataType.containsNull
    assert list(m.rows_from_frame(f, Row)) == rows
    assert list(m.rows_from_frame(f, Row, 1, 2)) == rows[1:]
    with pytest.raises(Invalid):
        m.schema_of(Row, ["a"])
    with pytest.raises(Invalid):
        list(m.rows_from_frame(m.frame_from_rows(spark, [(None,)], [Optional[int]], ["x"]), [int]))
    with pytest.raises(Invalid):
        m.frame_from_rows(spark, [([[1.0]],)], [tuple[list[float], list[float]]], ["x"])


def test_push_generator_and_streams(spark, tmp_path):
    g = push.PushGenerator()
    assert g.push(1) and g.push(2) and g.close() and not g.push(3) and not g.close()
    assert list(g) == [1, 2]
    with pytest.raises(Invalid):
        next(iter(g))
    h = push.PushGenerator()
    h.push(1)
    assert h.drain() == 1 and list(h) == []
    spark.range(10).withColumn("t", F.timestamp_seconds(F.col("id") * 30)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t timestamp").parquet(str(tmp_path / "in"))
    got = []
    q = push.fan_out(stream, [lambda b, n: got.append(b.count()), lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out{n}"))], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(got) == 10 and spark.read.parquet(str(tmp_path / "out0")).count() == 10
    agg = push.windowed(stream, "t", "2 minutes", "1 minute", [], [F.count("*").alias("n")])
    q = agg.writeStream.outputMode("complete").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("select n from wins").collect()) == [2, 4, 4]


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    core = {n for n in e.queries() if not n.startswith("op") and n != "pipeline"}
    assert core <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0


def test_pushdown_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_quantity", "l_tax")
    out = m.filter_rows(OrderedFrame.unordered(df), F.col("l_quantity") > 40, ["l_tax"]).df.select("l_orderkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(l_tax)" in plan and "GreaterThan(l_quantity" in plan and "l_extendedprice" not in plan


def test_places_and_segments_of_a_merge(spark):
    rng = random.Random(4)
    sides = [sorted((rng.randrange(400), i) for i in range(k, 900, 3)) for k in range(3)]
    frames = [OrderedFrame.explicit(spark.createDataFrame([(x, i) for x, i in s], "on long, i long"), "on", by=["on", "i"]) for s in sides]
    out = m.sorted_merge(frames, Ordering.explicit("on"))
    want = sorted((x, k, i) for k, s in enumerate(sides) for x, i in s)
    got = {r.i: r.place for r in numbered(out, "place").df.collect()}
    assert got == {i: n for n, (_, _, i) in enumerate(want)}
    data, chunk = chunked(out)
    assert data.select(chunk).distinct().count() > 8
    runs = []
    for x, _, i in want:
        if not runs or runs[-1][0] != x % 2:
            runs.append([x % 2, 0, i])
        runs[-1][1] += 1
    kinds = OrderedFrame(out.data.withColumn("kind", F.col("on") % 2), out.ordering)
    made = m.aggregate(kinds, [m.Agg("count_all", None, "n"), m.Agg("first", "i", "i")], segment_keys=["kind"])
    assert [list(r) for r in made.sorted().collect()] == runs


def test_chunks_of_text_follow_the_order(spark):
    words = [None, "", *sorted({"".join(random.Random(k).choices("abcé", k=k % 7 + 1)) for k in range(300)})]
    frame = OrderedFrame.implicit(spark.createDataFrame([(w,) for w in words], "w string"), by=["w"])
    data, chunk = chunked(frame, 10)
    got = [r[1] for r in data.select("w", chunk).orderBy("w").collect()]
    assert got == sorted(got) and 5 < len(set(got)) <= 10


def test_theta_join(spark):
    left = OrderedFrame.unordered(spark.createDataFrame([(1, 10), (2, 5), (None, 7)], "k long, x long"))
    right = OrderedFrame.unordered(spark.createDataFrame([(1, 3), (1, 30), (3, 1), (None, 1)], "k long, y long"))
    rows = lambda f: sorted(map(tuple, f.df.collect()), key=repr)
    assert rows(m.theta_join(left, right, "y < x", ["k"])) == [(1, 10, 3)]
    assert rows(m.theta_join(left, right, F.col("y") < F.col("x"), ["k"], "left")) == [(1, 10, 3), (2, 5, None), (None, 7, None)]
    assert (3, None, 1) in rows(m.theta_join(left, right, "y < x", ["k"], "full"))
    free = OrderedFrame.unordered(right.df.select("y"))
    assert rows(m.theta_join(left, free, "y > x")) == [(1, 10, 30), (2, 5, 30), (None, 7, 30)]
    assert rows(m.theta_join(left, free, "y > x", how="anti")) == []
    with pytest.raises(Invalid):
        m.theta_join(left, free, "y > x", small_rows=3)
    with pytest.raises(Invalid):
        m.theta_join(left, free, "y > x", how="full")
    with pytest.raises(Invalid):
        m.theta_join(left, right, "y > x")


def test_theta_join_deals_pairs(spark):
    rng = random.Random(11)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    xs = [(key(), i, rng.randrange(50)) for i in range(900)] + [(7, 900, 1), (None, 901, None)]
    ys = [(key(), i, rng.randrange(50)) for i in range(1100)] + [(8, 1100, 1), (2, 1101, None)]
    left = OrderedFrame.unordered(spark.createDataFrame(xs, "k int, a int, x int").repartition(3))
    right = OrderedFrame.unordered(spark.createDataFrame(ys, "k long, b int, y int").repartition(2))
    pairs = [(k, a, b) for k, a, x in xs for j, b, y in ys if k is not None and k == j and None not in (x, y) and y < x]
    lone_a, lone_b = [(k, a, None) for k, a, _ in xs if a not in {p[1] for p in pairs}], [(k, None, b) for k, b, _ in ys if b not in {p[2] for p in pairs}]
    joined = lambda how: m.theta_join(left, right, "y < x", ["k"], how, cell_pairs=10_000)
    found = lambda how: sorted(map(tuple, joined(how).df.select("k", "a", "b").collect()), key=repr)
    assert found("inner") == sorted(pairs, key=repr)
    assert found("left") == sorted(pairs + lone_a, key=repr)
    assert found("right_outer") == sorted(pairs + lone_b, key=repr)
    assert found("full") == sorted(pairs + lone_a + lone_b, key=repr)
    assert sorted(r.a for r in joined("anti").df.collect()) == sorted(p[1] for p in lone_a)
    assert sorted(r.a for r in joined("semi").df.collect()) == sorted({p[1] for p in pairs})
    assert joined("inner").df.columns == ["k", "a", "x", "b", "y"]
    for how in ("inner", "left", "right"):  # over half of the pairs are of one key
        tasks = [r["count"] for r in joined(how).df.groupBy(F.spark_partition_id()).count().collect()]
        assert max(tasks) < len(pairs) / 4


def test_theta_join_keys_of_any_type(spark):
    fl = [0.0, -0.0, float("nan"), 1.5, None] * 40
    left = OrderedFrame.unordered(spark.createDataFrame([(x, i) for i, x in enumerate(fl)], "k double, a int"))
    right = OrderedFrame.unordered(spark.createDataFrame([(x, i) for i, x in enumerate(fl)], "k float, b int"))
    plain, dealt = (sorted(map(tuple, m.theta_join(left, right, "b < a", ["k"], cell_pairs=c).df.select("a", "b").collect())) for c in (1 << 25, 100))
    assert plain == dealt and len(plain) == 80 * 79 // 2 + 2 * (40 * 39 // 2)
    same = OrderedFrame.unordered(spark.createDataFrame([("u", 1)] * 300, "k string, a int"))
    other = OrderedFrame.unordered(spark.createDataFrame([("u", 2)] * 300, "k string, b int"))
    tasks = [r["count"] for r in m.theta_join(same, other, "a < b", ["k"], cell_pairs=5_000).df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 90_000 and max(tasks) < 45_000  # rows that are equal in all columns


def test_theta_join_without_keys_deals_pairs(spark):
    left = OrderedFrame.unordered(spark.range(2000).select(F.col("id").alias("x")).coalesce(1))
    right = OrderedFrame.unordered(spark.range(100).select(F.col("id").alias("y")))
    tasks = [r["count"] for r in m.theta_join(left, right, "x >= y", cell_pairs=20_000).df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2000 * 100 - 99 * 100 // 2 and max(tasks) <= 25_000


def test_groupings(spark):
    rows = [("a", "x", 1), ("a", None, 2), ("b", "x", 4)]
    f = OrderedFrame.unordered(spark.createDataFrame(rows, "p string, q string, v long"))
    total = [Agg("sum", "v", "total")]
    found = lambda sets: {tuple(r) for r in m.aggregate_sets(f, total, ["p", "q"], sets).df.collect()}
    fine = {("a", "x", 0, 1), ("a", None, 0, 2), ("b", "x", 0, 4)}
    by_p, by_q = {("a", None, 1, 3), ("b", None, 1, 4)}, {(None, "x", 2, 5), (None, None, 2, 2)}
    assert found("cube") == fine | by_p | by_q | {(None, None, 3, 7)}
    assert found("rollup") == fine | by_p | {(None, None, 3, 7)}
    assert found([["p"], ["q"]]) == by_p | by_q
    for bad in ("all", [["v"]]):
        with pytest.raises(Invalid):
            m.aggregate_sets(f, total, ["p", "q"], bad)
    with pytest.raises(Invalid):
        m.aggregate_sets(f, [Agg("tdigest", "v", "d")], ["p"], "cube")


def test_analytic(spark):
    f = OrderedFrame.implicit(spark.createDataFrame([(1, "a", 5), (2, "b", 1), (3, "a", 2), (4, "a", 9)], "i long, k string, v long"), by=["i"])
    out = m.analytic(m.analytic(f, {"place": F.row_number()}, ["k"]), {"low": "min(v)"}, ["k"], (-1, 0))
    assert [tuple(r) for r in out.sorted().collect()] == [(1, "a", 5, 1, 5), (2, "b", 1, 1, 1), (3, "a", 2, 2, 2), (4, "a", 9, 3, 2)]
    with pytest.raises(Invalid):
        m.analytic(f, {"n": "count(*)"})
    with pytest.raises(Invalid):
        m.analytic(OrderedFrame.unordered(f.df), {"n": "count(*)"}, ["k"])


def test_stream_source(spark, tmp_path):
    schema = pa.schema([("x", pa.int32()), ("t", pa.string())])
    batch = lambda *v: pa.RecordBatch.from_pydict({"x": list(v), "t": [str(i) for i in v]}, schema=schema)
    generator = push.PushGenerator()
    stream, feed = m.stream_source(spark, schema, generator, str(tmp_path / "in"), "n", batches_per_trigger=1)
    seen = []
    start = lambda: stream.writeStream.foreachBatch(lambda b, i: seen.append([tuple(r) for r in b.orderBy("n").collect()])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    generator.push(batch(5, 4))
    generator.push(batch())
    generator.push(batch(7))
    with pytest.raises(TimeoutError):
        feed.finish(0.1)
    generator.close()
    assert feed.finish() == 3
    start()
    assert sum(seen, []) == [(5, "5", 0), (4, "4", 1), (7, "7", 2)] and max(map(len, seen)) == 2
    start()  # nothing is read twice
    assert len(sum(seen, [])) == 3
    _, broken = m.stream_source(spark, schema, [batch(1), pa.RecordBatch.from_pydict({"y": [1]})], str(tmp_path / "bad"))
    with pytest.raises(Invalid):
        broken.finish()
    with pytest.raises(Invalid):
        m.stream_source(spark, schema, [], str(tmp_path / "clash"), "x")
