"""As-of join: for each left row the right row nearest in time, within an inclusive interval.

With ``d = right.on - left.on`` a right row is eligible if ``lower <= d <= upper``. A single tolerance is short for
``[tol, 0]`` if negative, ``[0, tol]`` otherwise.

* ``upper <= 0``: the latest eligible row; of rows with one time the last.
* ``upper > 0``: the first row with exactly the left time; else the nearer of the first future row and the last past
  row, with a rule for equal distances.

Plan. Left and all right inputs are united once, each right row as a struct in a column of its own, and one window by
key and time finds all right inputs' candidates in a single shuffle and sort, however many inputs there are. To keep a
hot key, or a join without keys, from being one task, a key's time line is cut into ``buckets``: the window then runs
inside (key, bucket), and what lies in other buckets is carried in from one summary row per (key, bucket).
Null keys equal null keys. A null time never matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import Invalid
from ..ordering import SEQ, OrderedFrame, as_long, check_sorted, quoted, top_level

MIN, MAX = -(1 << 63), (1 << 63) - 1
_NOT_KEYS = (T.FloatType, T.DoubleType, T.ArrayType, T.MapType, T.StructType, T.NullType)


@dataclass(frozen=True)
class Keys:
    """One input's time column and equality columns."""

    on: str
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Bounds:
    lower: int
    upper: int
    prefer_earlier_on_tie: bool = True

    def __post_init__(self):
        if self.lower > self.upper:
            raise Invalid(f"lower bound {self.lower} is above upper bound {self.upper}")

    @classmethod
    def tolerance(cls, value: int) -> Bounds:
        return cls(value, 0) if value < 0 else cls(0, value)


def _field(df: DataFrame, name: str) -> T.StructField:
    try:
        return top_level(df, name)
    except KeyError as e:
        raise Invalid(str(e)) from e


def _validated(left: OrderedFrame, rights: Sequence[OrderedFrame], keys: Sequence[Keys]) -> None:
    if not rights or len(keys) != 1 + len(rights):
        raise Invalid("an as-of join needs a left and a right input, and keys for each")
    first_on = _field(left.data, keys[0].on).dataType
    first_by = [_field(left.data, b).dataType for b in keys[0].by]
    for frame, k in zip([left, *rights], keys, strict=True):
        if len(k.by) != len(keys[0].by):
            raise Invalid("inputs have different numbers of by-keys")
        on = _field(frame.data, k.on).dataType
        if on != first_on or as_long(F.col(quoted(k.on)), on) is None:
            raise Invalid(f"{k.on!r}: times must be integers, dates or timestamps of one type, not {on.simpleString()}")
        for b, want in zip(k.by, first_by, strict=True):
            kind = _field(frame.data, b).dataType
            if kind != want or isinstance(kind, _NOT_KEYS):
                raise Invalid(f"{b!r}: a by-key of type {kind.simpleString()}, not {want.simpleString()}")
        if not frame.ordering.ordered:
            raise Invalid("an as-of join needs ordered inputs")
        if frame.ordering.kind == "explicit" and not (frame.ordering.keys[0].name == k.on and frame.ordering.keys[0].ascending):
            raise Invalid(f"an explicit ordering must begin with {k.on!r}, ascending")


def output_schema(left: OrderedFrame, rights: Sequence[OrderedFrame], keys: Sequence[Keys], suffixes: Sequence[str] | None = None) -> T.StructType:
    """Left fields as they are, then each right input's other fields, nullable. No field is named twice."""
    _validated(left, rights, keys)
    fields = [T.StructField(f.name, f.dataType, f.nullable) for f in left.schema]
    for k, (frame, own) in enumerate(zip(rights, keys[1:], strict=True)):
        suffix = suffixes[k] if suffixes else ""
        fields += [T.StructField(f.name + suffix, f.dataType, True) for f in frame.schema if f.name not in (own.on, *own.by)]
    names = [f.name.lower() for f in fields]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise Invalid(f"output names repeat: {clash}; give one suffix for each right input")
    return T.StructType(fields)


def _moved(time: Column, by: int) -> Column:
    """``time + by``, held at the ends of the 64-bit range."""
    by = max(MIN, min(MAX, by))
    return F.coalesce(F.try_add(time, F.lit(by).cast("long")), F.when(time.isNotNull(), F.lit(MAX if by > 0 else MIN).cast("long")))


def _beyond(time: Column, by: int) -> Column:
    """Whether ``time + by`` lies outside the 64-bit range."""
    return time.isNotNull() & F.try_add(time, F.lit(max(MIN, min(MAX, by))).cast("long")).isNull()


def asof_join(
    left: OrderedFrame,
    rights: OrderedFrame | Sequence[OrderedFrame],
    keys: Sequence[Keys],
    tolerance: int | Bounds,
    suffixes: Sequence[str] | None = None,
    validate: str = "eager",
    buckets: int | None = None,
    hot_rows: int = 1_000_000,
) -> OrderedFrame:
    """Left columns, then each right input's columns but its keys. Bounds are in the time's unit (days, microseconds).

    ``validate="eager"`` checks that times arrive in order, at the cost of a pass over each input; ``"off"`` trusts the
    caller. ``buckets`` cuts each key's time line; by default into as many as the largest key has ``hot_rows`` (rows per
    key are counted), or without by-keys into four times the shuffle partitions.
    """
    rights = [rights] if isinstance(rights, OrderedFrame) else list(rights)
    schema = output_schema(left, rights, keys, suffixes)
    bounds = tolerance if isinstance(tolerance, Bounds) else Bounds.tolerance(tolerance)
    if validate not in ("eager", "off"):
        raise Invalid("validate is 'eager' or 'off'")
    if validate == "eager":
        for frame, k in zip([left, *rights], keys, strict=True):
            check_sorted(frame, k.on, frame.ordering.keys[0].nulls if frame.ordering.kind == "explicit" else None)
    latest = bounds.upper <= 0
    kind = _field(left.data, keys[0].on).dataType
    by_names = [f"b{i}" for i in range(len(keys[0].by))]

    def prepared(frame: OrderedFrame, k: Keys) -> tuple[DataFrame, list[str]]:
        on = as_long(F.col(quoted(k.on)), kind)
        return frame.data.withColumn("__on", on), [F.col(quoted(b)).alias(n) for b, n in zip(k.by, by_names, strict=True)]

    base, by = prepared(left, keys[0])
    shift = bounds.upper if latest else max(bounds.lower, 0)
    empty = [_payload(frame, k) for frame, k in zip(rights, keys[1:], strict=True)]
    order_type = [frame.data.schema[SEQ].dataType for frame in rights]
    packed = F.struct(*[F.col(quoted(c)) for c in left.data.columns], F.col("__on").alias("__on"))
    sides = [base.select(*by, _moved(F.col("__on"), shift).alias("t"), F.lit(1).alias("side"), packed.alias("l"), *[_none(kind_, i) for i, kind_ in enumerate(zip(empty, order_type, strict=True))])]
    left_type = sides[0].schema["l"].dataType
    for i, (frame, k) in enumerate(zip(rights, keys[1:], strict=True)):
        data, own = prepared(frame, k)
        value = F.struct(F.col("__on").alias("on"), F.struct(*[F.col(quoted(c)) for c in empty[i].fieldNames()]).alias("row") if empty[i].fields else F.lit(True).alias("row"), F.col(SEQ).alias("seq"))
        data = data.filter(F.col("__on").isNotNull())
        columns = [value.alias(f"p{j}") if j == i else _none((empty[j], order_type[j]), j) for j in range(len(rights))]
        sides.append(data.select(*own, F.col("__on").alias("t"), F.lit(0 if latest else 2).alias("side"), F.lit(None).cast(left_type).alias("l"), *columns))
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.union(s)
    if buckets is None:
        most = 4 * int(left.spark.conf.get("spark.sql.shuffle.partitions"))
        if by_names:
            largest = rows.groupBy(*by_names).count().agg(F.max("count")).first()[0] or 0
            most = min(most, -(-largest // hot_rows))
        buckets = max(1, most)
    group = list(by_names)
    if buckets > 1:
        rows, group = _bucketed(rows, group, buckets), [*group, "bucket"]
    tie_names = [f"p{i}.seq" for i in range(len(rights))]
    tie = [F.col(c).asc_nulls_first() for c in tie_names]
    window = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    # the next row is the last one of the reversed order: a frame that grows is evaluated once, one that shrinks is not
    past = window.orderBy(F.col("t").asc_nulls_first(), "side", *tie).rowsBetween(Window.unboundedPreceding, 0)
    future = window.orderBy(F.col("t").desc_nulls_last(), F.desc("side"), *[F.col(c).desc_nulls_last() for c in tie_names]).rowsBetween(Window.unboundedPreceding, 0)
    need_past = latest or bounds.lower < 0
    for i in range(len(rights)):
        p = F.col(f"p{i}")
        if need_past:
            rows = rows.withColumn(f"a{i}", F.last(p, ignorenulls=True).over(past))
        if not latest:
            rows = rows.withColumn(f"z{i}", F.last(p, ignorenulls=True).over(future))
    found = rows.filter("side = 1")
    if buckets > 1:
        found = _carried(rows, found, by_names, len(rights), need_past, not latest)
    time = F.col("l.__on")
    low, high = _moved(time, bounds.lower), _moved(time, bounds.upper)
    never = _beyond(time, bounds.upper) if bounds.upper < 0 else _beyond(time, bounds.lower) if bounds.lower > 0 else F.lit(False)
    columns = [F.col("l").getField(c).alias(c) for c in left.data.columns]
    for i, (frame_fields, suffix) in enumerate(zip(empty, suffixes or [""] * len(rights), strict=True)):
        a, z = F.col(f"a{i}"), F.col(f"z{i}")
        good_a = F.coalesce((a["on"] >= low) & ~never, F.lit(False)) if need_past else F.lit(False)
        good_z = F.coalesce((z["on"] <= high) & (z["on"] >= time) & ~never, F.lit(False)) if not latest else F.lit(False)
        if latest:
            pick = F.when(good_a, a)
        elif not need_past:
            pick = F.when(good_z, z)
        else:
            wide = [c.cast("decimal(21,0)") for c in (a["on"], time, z["on"])]
            back, ahead = wide[1] - wide[0], wide[2] - wide[1]
            nearer = (back <= ahead) if bounds.prefer_earlier_on_tie else (back < ahead)
            pick = F.when(good_a & good_z, F.when((ahead > 0) & nearer, a).otherwise(z)).when(good_a, a).when(good_z, z)
        columns += [pick["row"].getField(f).alias(f + suffix) for f in frame_fields.fieldNames()]
    out = found.select(*columns)
    assert [c for c in out.columns if c != SEQ] == schema.fieldNames()
    return OrderedFrame(out, left.ordering, left.non_null)


def _payload(frame: OrderedFrame, k: Keys) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in frame.schema if f.name not in (k.on, *k.by)])


def _none(kinds, i: int) -> Column:
    row, seq = kinds
    kind = T.StructType([T.StructField("on", T.LongType()), T.StructField("row", row if row.fields else T.BooleanType()), T.StructField("seq", seq)])
    return F.lit(None).cast(kind).alias(f"p{i}")


def _bucketed(rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Equal ranges of time; the range is one small aggregate over the inputs."""
    row = rows.agg(F.min("t"), F.max("t")).first()
    low, high = (row[0] or 0, row[1] or 0)
    width = (high - low) // buckets + 1
    wide = F.col("t").cast("decimal(21,0)") - F.lit(low).cast("decimal(21,0)")
    return rows.withColumn("bucket", F.coalesce(F.floor(wide / F.lit(width).cast("decimal(21,0)")).cast("long"), F.lit(-1).cast("long")))


def _carried(rows: DataFrame, found: DataFrame, by: list[str], n: int, past: bool, future: bool) -> DataFrame:
    """Fill what the window missed with the last or first right row of the buckets before or after."""
    summaries = []
    for i in range(n):
        p = F.col(f"p{i}")
        at = F.when(p.isNotNull(), F.struct(F.col("t"), p["seq"]))
        if past:
            summaries.append(F.max_by(p, at).alias(f"last{i}"))
        if future:
            summaries.append(F.min_by(p, at).alias(f"first{i}"))
    per = rows.select(*by, "bucket", "t", *[f"p{i}" for i in range(n)]).groupBy(*by, "bucket").agg(*summaries)
    line = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before, after = (line.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("bucket"), F.desc("bucket")))
    for i in range(n):
        if past:
            per = per.withColumn(f"ca{i}", F.last(f"last{i}", ignorenulls=True).over(before))
        if future:
            per = per.withColumn(f"cz{i}", F.last(f"first{i}", ignorenulls=True).over(after))
    names = {b: f"k_{b}" for b in [*by, "bucket"]}
    per = per.select(*[F.col(b).alias(names[b]) for b in names], *[c for c in per.columns if c[:2] in ("ca", "cz")])
    same = None
    for b, k in names.items():
        one = F.col(b).eqNullSafe(F.col(k))
        same = one if same is None else same & one
    found = found.join(per, same, "left")
    for i in range(n):
        if past:
            found = found.withColumn(f"a{i}", F.coalesce(f"a{i}", f"ca{i}"))
        if future:
            found = found.withColumn(f"z{i}", F.coalesce(f"z{i}", f"cz{i}"))
    return found
