"""t-digest: a mergeable sketch of a distribution, with map, reduce and quantile steps.

A digest is ``struct<centroids: array<struct<mean: double, weight: double>>, min: double, max: double>``. Tasks digest
their rows (per key) and emit partial digests; these are reduced in two rounds, the first over a bounded number of
salted groups per key, so that no task gets one digest from every task of a large scan.

Quantiles of a digest are approximate once it has merged values, from some tens of them on. Where the rows are at hand,
``refined`` takes exact ones from them: the digest says about where they lie, two more passes find them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..durable import settle
from ..errors import Invalid
from ..ordering import quoted

DIGEST = T.StructType(
    [
        T.StructField("centroids", T.ArrayType(T.StructType([T.StructField("mean", T.DoubleType(), False), T.StructField("weight", T.DoubleType(), False)]), False), False),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
    ]
)
_SALTS = 32
_HELD_KEYS = 4096
_AROUND = 0.01
_BROADCAST_KEYS = 10_000


@dataclass(frozen=True)
class Options:
    """``delta`` bounds the number of centroids; ``scaler`` is K0 (even) or K1 (finer at the ends)."""

    q: tuple[float, ...] = (0.5,)
    delta: int = 100
    buffer_size: int = 500
    skip_nulls: bool = True
    min_count: int = 0
    scaler: str = "K1"

    def __post_init__(self):
        object.__setattr__(self, "q", tuple(float(x) for x in (self.q if isinstance(self.q, Sequence) else [self.q])))
        if self.delta <= 0:
            raise Invalid("delta must be positive")
        if self.buffer_size <= 0:
            raise Invalid("buffer_size must be positive")
        if self.scaler not in ("K0", "K1"):
            raise Invalid(f"unknown scaler {self.scaler!r}")
        if any(not math.isfinite(x) or not 0 <= x <= 1 for x in self.q):
            raise Invalid("probabilities must lie in [0, 1]")

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"version": 1})

    @classmethod
    def from_json(cls, text: str) -> Options:
        made = json.loads(text)
        if made.pop("version", None) != 1:
            raise Invalid("unknown version of t-digest options")
        return cls(**made | {"q": tuple(made["q"])})


class Digest:
    """Sorted centroids plus a buffer of values that have not been merged yet."""

    def __init__(self, options: Options):
        self.o = options
        self.mean, self.weight = np.zeros(0), np.zeros(0)
        self.low, self.high = math.inf, -math.inf
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.valid = True

    def add(self, values: np.ndarray) -> None:
        values = values[~np.isnan(values)]
        at = 0
        while at < len(values):
            room = self.o.buffer_size - self.n_waiting
            part = values[at : at + room]
            self.waiting.append(part)
            self.n_waiting += len(part)
            at += len(part)
            if self.n_waiting == self.o.buffer_size:
                self.flush()

    def flush(self) -> None:
        if not self.n_waiting:
            return
        fresh = np.sort(np.concatenate(self.waiting))
        self.waiting, self.n_waiting = [], 0
        self.low, self.high = min(self.low, fresh[0]), max(self.high, fresh[-1])
        self._absorb(fresh, np.ones(len(fresh)))

    def merge(self, mean: np.ndarray, weight: np.ndarray, low: float | None, high: float | None) -> None:
        """Add another digest's centroids."""
        if len(mean) and (low is None or high is None or not low <= high):
            raise Invalid("a digest with centroids needs min and max")
        if not len(mean):
            if low is not None or high is not None:
                raise Invalid("an empty digest has no min and max")
            return
        if not (np.isfinite(weight).all() and (weight > 0).all()):
            raise Invalid("centroid weights must be positive and finite")
        self.flush()
        self.low, self.high = min(self.low, low), max(self.high, high)
        order = np.argsort(mean, kind="stable")
        self._absorb(mean[order], weight[order])

    def _absorb(self, mean: np.ndarray, weight: np.ndarray) -> None:
        """Merge sorted points with the centroids (points first among equals) and compress."""
        at = np.searchsorted(self.mean, mean, "left")
        mean, weight = np.insert(self.mean, at, mean), np.insert(self.weight, at, weight)
        total = float(weight.sum())
        ends = np.cumsum(weight)
        starts, i = [], 0
        while i < len(mean):  # each centroid takes all points up to its limit
            starts.append(i)
            before = ends[i] - weight[i]
            limit = self._limit(before / total) * total
            if limit <= before:
                limit = total
            i = max(i + 1, int(np.searchsorted(ends, limit, "right")))
        heads = np.array(starts)
        self.weight = np.add.reduceat(weight, heads)
        self.mean = np.add.reduceat(mean * weight, heads) / self.weight
        single = np.diff(np.r_[heads, len(mean)]) == 1
        self.mean[single] = mean[heads[single]]
        np.maximum.accumulate(self.mean, out=self.mean)

    def _limit(self, q: float) -> float:
        """The share of weight one step of the scale function further."""
        if self.o.scaler == "K0":
            return q + 2 / self.o.delta
        angle = math.asin(2 * q - 1) + 2 * math.pi / self.o.delta
        return (math.sin(angle) + 1) / 2 if angle < math.pi / 2 else 1.0

    def result(self) -> dict | None:
        self.flush()
        if not self.valid:
            return None
        empty = not len(self.mean)
        return {"centroids": [{"mean": m, "weight": w} for m, w in zip(self.mean.tolist(), self.weight.tolist(), strict=True)], "min": None if empty else self.low, "max": None if empty else self.high}


def quantiles(digest: dict | None, options: Options) -> list[float | None] | None:
    """The asked quantiles; all null if the digest is empty or lighter than ``min_count``; None of a null digest."""
    if digest is None:
        return None
    mean = np.array([c["mean"] for c in digest["centroids"]])
    weight = np.array([c["weight"] for c in digest["centroids"]])
    if not len(mean) or weight.sum() < options.min_count:
        return [None] * len(options.q)
    ends = np.cumsum(weight)
    centre = ends - weight / 2
    total = ends[-1]
    # between centres the value is linear; outside them it runs to min and max
    xs, ys = np.r_[0.0, centre, total], np.r_[digest["min"], mean, digest["max"]]
    out = []
    for q in options.q:
        index = q * total
        if index <= 1:
            out.append(digest["min"])
        elif index >= total - 1:
            out.append(digest["max"])
        else:
            i = min(int(np.searchsorted(ends, index, "left")), len(mean) - 1)
            if weight[i] == 1 and abs(index - centre[i]) < 0.5:
                out.append(float(mean[i]))
            else:
                out.append(float(np.interp(index, xs, ys)))
    return out


def _checked(digest) -> tuple[np.ndarray, np.ndarray, float | None, float | None]:
    if digest["centroids"] is None:
        raise Invalid("a digest's centroids must not be null")
    return np.array([c["mean"] for c in digest["centroids"]], float), np.array([c["weight"] for c in digest["centroids"]], float), digest["min"], digest["max"]


def _partial(options: Options, names: list[str], digests: bool, schema: pa.Schema):
    """Rows of a task to one digest per key (or several, if there are many keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[dict, Digest]] = {}

        def out():
            rows = [key | {"digest": d.result()} for key, d in held.values()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = table.column("__value")
            for key, at in _groups(table, names):
                mark = tuple(key.values())
                if mark not in held:
                    if len(held) >= _HELD_KEYS:
                        yield out()
                    held[mark] = (key, Digest(options))
                d = held[mark][1]
                part = values.take(at) if at is not None else values
                if digests:
                    for x in part.to_pylist():
                        if x is None:
                            d.valid = False
                        else:
                            d.merge(*_checked(x))
                else:
                    if part.null_count and not options.skip_nulls:
                        d.valid = False
                    d.add(part.drop_null().to_numpy().astype(float))
        if held or not names:
            if not held:
                held[()] = ({}, Digest(options))
            yield out()

    return run


def _groups(table: pa.Table, names: list[str]):
    if not names:
        yield {}, None
        return
    indexed = table.select(names).append_column("__row", pa.array(np.arange(table.num_rows)))
    for g in indexed.group_by(names).aggregate([("__row", "list")]).to_pylist():
        yield {n: g[n] for n in names}, pa.array(g["__row_list"])


def _reduced(rows: DataFrame, keys: list[str], options: Options) -> DataFrame:
    """One digest per key from the partial ones: salted groups first, then the rest."""
    own = replace(options, buffer_size=options.delta)
    kinds = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    for salts in (_SALTS, 1):
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int")).withColumnRenamed("digest", "__value")
        out = T.StructType([*kinds, T.StructField("digest", DIGEST)])
        groups = [*keys, "__salt"]

        def reduce_group(table: pa.Table) -> pa.Table:
            d = Digest(own)
            for x in table.column("__value").to_pylist():
                if x is None:
                    d.valid = False
                else:
                    d.merge(*_checked(x))
            row = {k: table.column(k)[0].as_py() for k in keys} | {"digest": d.result()}
            return pa.Table.from_pylist([row], schema=_arrow(out))

        rows = salted.groupBy(*groups).applyInArrow(reduce_group, out)
    return rows


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _numeric(kind: T.DataType) -> None:
    if not isinstance(kind, T.NumericType):
        raise NotImplementedError(f"a t-digest of {kind.simpleString()}")


def digest_map(df: DataFrame, keys: Sequence[str], column: str, options: Options | None = None) -> DataFrame:
    """``keys..., digest``: a digest of a numeric column per key; without keys one row, of no input too."""
    options = options or Options()
    _numeric(df.schema[column].dataType)
    value = F.col(f"`{column}`").cast("double").alias("__value")
    return _digests(df.select(*[F.col(f"`{k}`") for k in keys], value), list(keys), options, False)


def digest_reduce(df: DataFrame, keys: Sequence[str], column: str, options: Options | None = None) -> DataFrame:
    """``keys..., digest``: the union of a digest column per key. A null digest makes the result null."""
    options = options or Options()
    value = F.col(f"`{column}`").alias("__value")
    if df.schema[column].dataType.simpleString() != DIGEST.simpleString():
        raise Invalid(f"{column!r} is no digest but {df.schema[column].dataType.simpleString()}")
    return _digests(df.select(*[F.col(f"`{k}`") for k in keys], value), list(keys), replace(options, buffer_size=options.delta), True)


def _digests(rows: DataFrame, keys: list[str], options: Options, digests: bool) -> DataFrame:
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], T.StructField("digest", DIGEST)])
    parts = rows.mapInArrow(_partial(options, keys, digests, _arrow(schema)), schema)
    out = _reduced(parts, keys, options)
    if keys:
        return out
    one = df_of_one(rows).select(F.lit(None).cast(DIGEST).alias("e"))
    blank = F.struct(F.array().cast(DIGEST["centroids"].dataType).alias("centroids"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    # a scan without partitions yields no row: the result is then the empty digest
    return one.join(out.withColumn("__found", F.lit(True)), F.lit(True), "left").select(F.when(F.col("__found"), F.col("digest")).otherwise(blank).alias("digest"))


def df_of_one(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1)


def quantile_elementwise(df: DataFrame, column: str, name: str, options: Options | None = None) -> DataFrame:
    """Quantiles of each row's digest, as an array; a null digest gives a null array."""
    options = options or Options()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts):
        import pandas as pd

        def one(c, low, high):
            return None if c is None else quantiles({"centroids": list(c), "min": low, "max": high}, options)

        made = [one(c, None if pd.isna(low) else low, None if pd.isna(high) else high) for c, low, high in zip(parts["centroids"], parts["min"], parts["max"], strict=True)]
        return pd.Series(made, dtype=object)

    return df.withColumn(name, F.when(F.col(f"`{column}`").isNotNull(), run(F.col(f"`{column}`"))))


def _nulled(df: DataFrame, column: str, options: Options) -> DataFrame:
    """A null digest of an aggregate gives an array of nulls."""
    nulls = F.array(*[F.lit(None).cast("double") for _ in options.q])
    return df.withColumn(column, F.coalesce(F.col(column), nulls))


def refined(digests: DataFrame, keys: Sequence[str], rows: DataFrame, column: str, options: Options | None = None) -> DataFrame:
    """``digests`` (``keys..., digest``, one row per key) with ``quantiles`` of a numeric column of ``rows``, exactly what
    digests that never merge two values would give.

    The digest's values beside each quantile cut a key's rows into ranges. One pass counts them, which tells the ranges
    of the wanted ranks; a second one counts the different values of these ranges only, and takes those at the ranks. A
    digest that is far off makes for wide ranges, not for other results. Values of one range are sorted in one task.
    """
    options = options or Options()
    _numeric(rows.schema[column].dataType)
    if not options.q:
        return quantile_elementwise(digests, "digest", "quantiles", options)
    cuts = sorted({min(max(q + by, 0.0), 1.0) for q in options.q for by in (-_AROUND, _AROUND)})
    rough = quantile_elementwise(quantile_elementwise(digests, "digest", "quantiles", options), "digest", "__cuts", Options(q=tuple(cuts)))
    held = settle(rough)  # every pass must see the same cuts, and a digest depends on the order of its parts
    few = held.count() <= _BROADCAST_KEYS
    own = [f"__k{i}" for i in range(len(keys))]

    def meet(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
        """Join by the columns ``own``, null-safe, and ``names``."""
        other = right
        same = F.lit(True)
        for n in [*own, *names]:
            other = other.withColumnRenamed(n, f"{n}_")
            same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
        return left.join(F.broadcast(other) if few else other, same, how).drop(*[f"{n}_" for n in [*own, *names]])

    marked = [F.col(quoted(k)).alias(o) for k, o in zip(keys, own, strict=True)]
    values = rows.select(*marked, F.col(quoted(column)).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    known = held.filter(F.col("__cuts").isNotNull()).select(*marked, "__cuts")
    place = sum((F.coalesce(F.col("__cuts")[j] < F.col("__v"), F.lit(False)).cast("int") for j in range(len(cuts))), F.lit(0))
    placed = meet(values, known, []).select(*own, place.alias("__range"), "__v")

    by_key = Window.partitionBy(*own)
    counted = placed.groupBy(*own, "__range").agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__total", F.sum("__n").over(by_key)).withColumn("__end", F.sum("__n").over(by_key.orderBy("__range")))
    begin = F.col("__end") - F.col("__n")
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("rank")) for i, q in enumerate(options.q) for r in _ranks(q, F.col("__total"))])
    inside = F.transform(F.filter(ranks, lambda r: (r["rank"] > begin) & (r["rank"] <= F.col("__end"))), lambda r: F.struct(r["i"].alias("i"), (r["rank"] - begin).alias("rank")))
    wanted = counted.select(*own, "__range", inside.alias("__ranks")).filter(F.size("__ranks") > 0)

    different = meet(placed, wanted, ["__range"]).groupBy(*own, "__range", "__v").agg(F.count("*").alias("__n"), F.first("__ranks").alias("__ranks"))
    different = different.withColumn("__end", F.sum("__n").over(Window.partitionBy(*own, "__range").orderBy("__v")))
    hit = F.filter("__ranks", lambda r: (r["rank"] > F.col("__end") - F.col("__n")) & (r["rank"] <= F.col("__end")))
    found = different.select(*own, "__v", F.explode(hit).alias("__r"))

    def middle(i: int):
        low, high = (f(F.when(F.col("__r.i") == i, F.col("__v"))) for f in (F.min, F.max))
        return F.when(low < high, (low + high) / 2).otherwise(low)

    exact = found.groupBy(*own).agg(F.array(*[middle(i) for i in range(len(options.q))]).alias("__exact"))
    out = meet(held.select("*", *marked), exact, [], "left")
    settled = F.transform("quantiles", lambda x, i: F.when(x.isNotNull(), F.get("__exact", i)))
    return out.withColumn("quantiles", settled).drop("__cuts", "__exact", *own)


def _ranks(q: float, total):
    """The ranks, from 1 on, whose values' mean is a quantile of single values: one twice, or two neighbours."""
    index = F.lit(q) * total
    first = F.when(index <= 1, F.lit(1).cast("long")).when(index >= total - 1, total).otherwise(F.ceil(index))
    between = (index > 1) & (index < total - 1) & (index == F.floor(index))
    return first, F.when(between, first + 1).otherwise(first)


def quantile(df: DataFrame, keys: Sequence[str], column: str, options: Options | None = None, of: tuple[DataFrame, str] | None = None) -> DataFrame:
    """``keys..., quantiles`` of a digest column; with ``of``, the rows and the column that were digested, exact ones."""
    return _quantiles(digest_reduce(df, keys, column, options), keys, options or Options(), of)


def tdigest(df: DataFrame, keys: Sequence[str], column: str, options: Options | None = None, exact: bool = False) -> DataFrame:
    """``keys..., quantiles`` of a numeric column."""
    return _quantiles(digest_map(df, keys, column, options), keys, options or Options(), (df, column) if exact else None)


def _quantiles(digests: DataFrame, keys: Sequence[str], options: Options, of: tuple[DataFrame, str] | None) -> DataFrame:
    out = refined(digests, keys, *of, options) if of else quantile_elementwise(digests, "digest", "quantiles", options)
    return _nulled(out.drop("digest"), "quantiles", options)


def approximate_median(df: DataFrame, keys: Sequence[str], column: str, skip_nulls: bool = True, min_count: int = 0, exact: bool = False) -> DataFrame:
    """``keys..., median``."""
    out = tdigest(df, keys, column, Options(skip_nulls=skip_nulls, min_count=min_count), exact)
    return out.select(*[F.col(f"`{k}`") for k in keys], F.col("quantiles")[0].alias("median"))


def aggregate_frame(df: DataFrame, keys: list[str], target: str, function: str, options: dict, name: str) -> DataFrame:
    """An aggregate of this family as ``keys..., name``."""
    made = {
        "tdigest": lambda: tdigest(df, keys, target, Options(**options)).withColumnRenamed("quantiles", name),
        "tdigest_map": lambda: digest_map(df, keys, target, Options(**options)).withColumnRenamed("digest", name),
        "tdigest_reduce": lambda: digest_reduce(df, keys, target, Options(**options)).withColumnRenamed("digest", name),
        "tdigest_quantile": lambda: quantile(df, keys, target, Options(**options)).withColumnRenamed("quantiles", name),
        "approximate_median": lambda: approximate_median(df, keys, target, **options).withColumnRenamed("median", name),
    }
    return made[function]()
