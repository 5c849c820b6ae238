"""Row order made explicit.

A DataFrame has no order. ``OrderedFrame`` pairs one with an ordering: *unordered*, *implicit* (the order of arrival,
carried by a hidden sequence column) or *explicit* (sort keys, with the sequence column breaking ties). Operators that
depend on order reject unordered input. The sequence column never reaches results: ``df`` and ``columns`` leave it out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .errors import Invalid

SEQ = "__seq"


@dataclass(frozen=True)
class SortKey:
    name: str
    ascending: bool = True
    nulls: str = "first"

    def __post_init__(self):
        if self.nulls not in ("first", "last"):
            raise Invalid(f"nulls are placed 'first' or 'last', not {self.nulls!r}")

    def column(self) -> Column:
        c = F.col(quoted(self.name))
        if self.ascending:
            return c.asc_nulls_first() if self.nulls == "first" else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls == "first" else c.desc_nulls_last()


@dataclass(frozen=True)
class Ordering:
    kind: str
    keys: tuple[SortKey, ...] = ()

    @classmethod
    def unordered(cls) -> Ordering:
        return cls("unordered")

    @classmethod
    def implicit(cls) -> Ordering:
        return cls("implicit")

    @classmethod
    def explicit(cls, *keys: str | SortKey, nulls: str | None = None) -> Ordering:
        """Sort keys; ``nulls`` overrides the placement of all of them."""
        made = tuple(k if isinstance(k, SortKey) else SortKey(k) for k in keys)
        if not made:
            raise Invalid("an explicit ordering needs a sort key")
        if nulls is not None:
            made = tuple(SortKey(k.name, k.ascending, nulls) for k in made)
        return cls("explicit", made)

    @property
    def ordered(self) -> bool:
        return self.kind != "unordered"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class OrderedFrame:
    """A DataFrame with its ordering. ``data`` holds the sequence column if there is an order."""

    data: DataFrame
    ordering: Ordering
    non_null: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def unordered(cls, df: DataFrame) -> OrderedFrame:
        return cls(df, Ordering.unordered())

    @classmethod
    def implicit(cls, df: DataFrame, by: Sequence[str] = ()) -> OrderedFrame:
        """Order of arrival. ``by`` names the columns that define it; without them rows are numbered as they are read,
        which is stable for a fixed layout of files and partitions only."""
        return cls(_with_seq(df, by), Ordering.implicit())

    @classmethod
    def explicit(cls, df: DataFrame, *keys: str | SortKey, nulls: str | None = None, by: Sequence[str] = ()) -> OrderedFrame:
        """Declares that rows arrive sorted by ``keys``; ``by`` names the columns that define arrival."""
        ordering = Ordering.explicit(*keys, nulls=nulls)
        for k in ordering.keys:
            top_level(df, k.name)
        return cls(_with_seq(df, by), ordering)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.data.columns if c != SEQ]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in self.non_null, f.metadata) for f in self.data.schema if f.name != SEQ])

    @property
    def df(self) -> DataFrame:
        return self.data.drop(SEQ) if SEQ in self.data.columns else self.data

    @property
    def spark(self):
        return self.data.sparkSession

    def order_columns(self) -> list[Column]:
        if not self.ordering.ordered:
            raise Invalid("this operation needs ordered input")
        return [k.column() for k in self.ordering.keys] + [F.col(SEQ)]

    def sorted(self) -> DataFrame:
        """The rows in order."""
        return self.data.orderBy(*self.order_columns()).drop(SEQ)

    def with_data(self, data: DataFrame) -> OrderedFrame:
        return OrderedFrame(data, self.ordering, self.non_null)


def _with_seq(df: DataFrame, by: Sequence[str]) -> DataFrame:
    if SEQ in df.columns:
        raise Invalid(f"the name {SEQ} is reserved")
    if not by:
        return df.withColumn(SEQ, F.monotonically_increasing_id())
    for name in by:
        top_level(df, name)
    made = F.col(quoted(by[0])) if len(by) == 1 else F.struct(*[F.col(quoted(b)) for b in by])
    return df.withColumn(SEQ, made)


def top_level(df: DataFrame, name: str) -> T.StructField:
    """The field of a top-level column; KeyError if there is none or more than one."""
    found = [f for f in df.schema.fields if f.name == name]
    if len(found) != 1:
        raise KeyError(f"no column {name!r}" if not found else f"column {name!r} is ambiguous")
    return found[0]


def chunked(frame: OrderedFrame, chunks: int | None = None) -> tuple[DataFrame, str]:
    """The data with a column that deals it into consecutive chunks of the order: equal chunk numbers form a run of
    arrivals, and larger numbers come later. The numbers are a function of the row alone, so every execution agrees.

    Sequences of numbers or times are dealt by equal ranges, others by splitters drawn from a sample of the sequence.
    """
    kind = frame.data.schema[SEQ].dataType
    name = "__chunk"
    place = as_long(F.col(SEQ), kind)
    chunks = chunks or 4 * int(frame.spark.conf.get("spark.sql.shuffle.partitions"))
    if place is None:
        return frame.data.withColumn(name, _split(frame.data, kind, min(chunks, MOST_SPLITS))), name
    row = frame.data.agg(F.min(place), F.max(place)).first()
    low, high = row[0] or 0, row[1] or 0
    width = (int(high) - int(low)) // chunks + 1
    number = F.floor((place.cast("decimal(20,0)") - F.lit(int(low)).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
    return frame.data.withColumn(name, F.coalesce(number, F.lit(-1).cast("long"))), name


#: Splitters are compared one by one inside an expression, which should stay small enough to be compiled.
MOST_SPLITS = 64


def _split(data: DataFrame, kind: T.DataType, chunks: int, per_chunk: int = 100) -> Column:
    """How many splitters a sequence is not below; a null is below all."""
    seq, total = data.select(SEQ), data.count()
    share = min(1.0, per_chunk * chunks / max(total, 1))
    drawn = [r[0] for r in (seq.sample(share, 5) if share < 1 else seq).orderBy(SEQ).limit(2 * per_chunk * chunks).collect()]
    drawn = [x for x in drawn if x is not None]
    places = sorted({len(drawn) * k // chunks for k in range(1, chunks)}) if drawn else []
    splitters = [_literal(drawn[k], kind) for k in places]

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        return F.when(F.coalesce(F.col(SEQ) < splitters[middle], F.lit(True)), below(low, middle)).otherwise(below(middle + 1, high))

    return below(0, len(splitters))


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind, strict=True)])
    return F.lit(value).cast(kind)


def numbered(frame: OrderedFrame, name: str) -> OrderedFrame:
    """The frame with each row's 0-based place in its sequence. Chunks are numbered in parallel; their counts meet in a window."""
    if not frame.ordering.ordered:
        raise Invalid("only ordered rows have places")
    data, chunk = chunked(frame)
    per = data.groupBy(F.col(chunk).alias("__of")).agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("__of", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(chunk).orderBy(SEQ)) - 1
    out = data.withColumn("__inside", inside).join(F.broadcast(per), F.col(chunk) == F.col("__of"))  # one row per chunk
    return frame.with_data(out.withColumn(name, F.col("__before") + F.col("__inside")).drop(chunk, "__of", "__before", "__inside"))


def as_long(c: Column, kind: T.DataType) -> Column | None:
    """An order-preserving 64-bit number for integers, dates, timestamps and unsigned 64-bit decimals; else None."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision == 20:
        return (c.cast("decimal(21,0)") - F.lit(str(1 << 63)).cast("decimal(21,0)")).cast("long")
    return None


def check_sorted(frame: OrderedFrame, name: str, nulls: str | None) -> None:
    """Raise Invalid unless the column is non-decreasing in order of arrival and nulls are placed as declared.

    ``nulls=None`` lets nulls stand anywhere. Chunks are checked in parallel; the driver compares one summary of each.
    """
    data, chunk = chunked(OrderedFrame(frame.data.select(F.col(quoted(name)).alias("v"), SEQ), Ordering.implicit()) if name != SEQ else frame)
    w = Window.partitionBy(chunk).orderBy(SEQ)
    value = F.col("v")
    before = F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bad = before > value
    if nulls == "first":
        bad = F.coalesce(bad, F.lit(False)) | (value.isNull() & before.isNotNull())
    if nulls == "last":
        seen_null = F.max(value.isNull()).over(w.rowsBetween(Window.unboundedPreceding, -1))
        bad = F.coalesce(bad, F.lit(False)) | (value.isNotNull() & F.coalesce(seen_null, F.lit(False)))
    rows = data.withColumn("bad", F.coalesce(bad, F.lit(False)))
    parts = rows.groupBy(chunk).agg(F.max("bad").alias("bad"), F.min("v").alias("low"), F.max("v").alias("high"), F.max(value.isNull()).alias("null")).orderBy(chunk).collect()
    high, null = None, False
    for r in parts:
        broken = r["bad"] or (high is not None and r["low"] is not None and r["low"] < high)
        broken = broken or (nulls == "first" and high is not None and r["null"]) or (nulls == "last" and null and r["low"] is not None)
        if broken:
            raise Invalid(f"{name!r} is not in its declared order")
        high = r["high"] if r["high"] is not None else high
        null = null or r["null"]
