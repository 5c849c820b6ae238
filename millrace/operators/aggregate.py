"""Aggregation: scalar, grouped, and segmented (by runs of equal consecutive keys).

Segments are numbered without a global sort in one task: chunks of the order number their own runs in parallel, one
summary row per chunk says where runs go on across a border, and its offsets are joined back. After that a segment is
an ordinary group, with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import Invalid
from ..functions import tdigest as td
from ..ordering import SEQ, OrderedFrame, Ordering, chunked, quoted, top_level


@dataclass(frozen=True)
class Agg:
    """``function`` of ``target`` (None: all rows) under ``name``; options depend on the function."""

    function: str
    target: str | None
    name: str
    options: dict[str, Any] = field(default_factory=dict)


def _skipping(make):
    return lambda c, o: make(c)


def _first(c: Column, o: dict, pick) -> Column:
    order = F.when(c.isNotNull(), F.col(SEQ)) if o.get("skip_nulls", True) else F.col(SEQ)
    return pick(c, order)


_PLAIN = {
    "sum": _skipping(F.sum),
    "product": _skipping(F.product),
    "mean": _skipping(F.avg),
    "min": _skipping(F.min),
    "max": _skipping(F.max),
    "any": _skipping(F.bool_or),
    "all": _skipping(F.bool_and),
    "count": lambda c, o: {"only_null": F.count_if(c.isNull()), "all": F.count("*")}.get(o.get("mode", "only_valid"), F.count(c)),
    "count_all": lambda c, o: F.count("*"),
    "count_distinct": _skipping(F.count_distinct),
    "variance": lambda c, o: F.var_samp(c) if o.get("ddof", 0) else F.var_pop(c),
    "stddev": lambda c, o: F.stddev_samp(c) if o.get("ddof", 0) else F.stddev_pop(c),
    "one": _skipping(F.any_value),
    "list": _skipping(F.collect_list),
    "distinct": _skipping(F.collect_set),
    "approx_count_distinct": _skipping(F.approx_count_distinct),
}
_ORDERED = {"first": lambda c, o: _first(c, o, F.min_by), "last": lambda c, o: _first(c, o, F.max_by)}
_DIGESTS = ("tdigest", "tdigest_map", "tdigest_reduce", "tdigest_quantile", "approximate_median")
FUNCTIONS = (*_PLAIN, *_ORDERED, *_DIGESTS)


def _name(function: str) -> str:
    base = function.removeprefix("hash_").removeprefix("scalar_")
    if base not in FUNCTIONS:
        raise KeyError(f"no aggregate function {function!r}")
    return base


def aggregate(frame: OrderedFrame, aggregates: Sequence[Agg], keys: Sequence[str] = (), segment_keys: Sequence[str] = ()) -> OrderedFrame:
    """Segment keys, keys, then the aggregates. Without keys one row even of no input; with segment keys one per run.

    Null segment keys are equal to each other. ``first`` and ``last`` need ordered input, as segment keys do; they skip
    nulls unless told otherwise.
    """
    if set(keys) & set(segment_keys):
        raise Invalid(f"both key and segment key: {sorted(set(keys) & set(segment_keys))}")
    for k in [*keys, *segment_keys, *[a.target for a in aggregates if a.target is not None]]:
        top_level(frame.data, k)
    names = [*segment_keys, *keys, *[a.name for a in aggregates]]
    if len(set(names)) != len(names):
        raise Invalid(f"output names repeat: {names}")
    functions = [_name(a.function) for a in aggregates]
    if (segment_keys or any(f in _ORDERED for f in functions)) and not frame.ordering.ordered:
        raise Invalid("segment keys and ordered functions need ordered input")
    data, group = frame.data, [quoted(k) for k in [*segment_keys, *keys]]
    if segment_keys:
        data, segment = segments(frame, segment_keys)
        group = [segment, *group]
    plain = [(_PLAIN | _ORDERED)[f](F.col(quoted(a.target)) if a.target else None, a.options).alias(a.name) for a, f in zip(aggregates, functions, strict=True) if f not in _DIGESTS]
    arrival = [F.min(SEQ).alias(SEQ)] if frame.ordering.ordered and group else []
    outs: list[DataFrame] = []
    if plain or arrival or not aggregates or not group:
        made = plain + arrival or [F.count("*").alias("__rows")]
        outs.append(data.groupBy(*group).agg(*made) if group else data.agg(*made))
    for a, f in zip(aggregates, functions, strict=True):
        if f in _DIGESTS:
            outs.append(td.aggregate_frame(data, [g.strip("`") for g in group], a.target, f, a.options, a.name))
    out = outs[0]
    for other in outs[1:]:
        out = _beside(out, other, [g.strip("`") for g in group])
    kept = [F.col(quoted(n)) for n in names] + ([F.col(SEQ)] if arrival else [])
    ordering = Ordering.unordered()
    if arrival:
        ordering = Ordering.implicit()
        if segment_keys and frame.ordering.kind == "explicit":
            prefix = []
            for k in frame.ordering.keys:
                if k.name not in segment_keys:
                    break
                prefix.append(k)
            ordering = Ordering("explicit", tuple(prefix)) if prefix else ordering
    return OrderedFrame(out.select(*kept), ordering)


def aggregate_sets(frame: OrderedFrame, aggregates: Sequence[Agg], keys: Sequence[str], sets: str | Sequence[Sequence[str]], level: str = "grouping_id") -> OrderedFrame:
    """Aggregates of several groupings in one pass: ``sets`` is "cube", "rollup" or a list of subsets of the keys.
    ``level`` has a bit set for each key left out (the last key's is the lowest), as null may be a key's value too."""
    names = [*keys, level, *[a.name for a in aggregates]]
    if len(set(names)) != len(names):
        raise Invalid(f"output names repeat: {names}")
    functions = [_name(a.function) for a in aggregates]
    if any(f not in _PLAIN for f in functions):
        raise Invalid(f"several groupings take only {', '.join(_PLAIN)}")
    for k in [*keys, *[a.target for a in aggregates if a.target is not None]]:
        top_level(frame.data, k)
    columns = [F.col(quoted(k)) for k in keys]
    if isinstance(sets, str):
        if sets not in ("cube", "rollup"):
            raise Invalid(f"no kind of grouping {sets!r}")
        grouped = getattr(frame.data, sets)(*columns)
    else:
        unknown = {k for s in sets for k in s} - set(keys)
        if unknown:
            raise Invalid(f"no keys: {sorted(unknown)}")
        grouped = frame.data.groupingSets([[F.col(quoted(k)) for k in s] for s in sets], *columns)
    made = [_PLAIN[f](F.col(quoted(a.target)) if a.target else None, a.options).alias(a.name) for a, f in zip(aggregates, functions, strict=True)]
    out = grouped.agg(F.grouping_id().cast("long").alias(level), *made)
    return OrderedFrame.unordered(out.select(*[F.col(quoted(n)) for n in names]))


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return a.crossJoin(b)  # one row each
    renamed = b.select(*[F.col(quoted(k)).alias(f"__r{i}") for i, k in enumerate(keys)], *[F.col(quoted(c)) for c in b.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(quoted(k)).eqNullSafe(F.col(f"__r{i}"))
    return a.join(renamed, same).drop(*[f"__r{i}" for i in range(len(keys))])


def segments(frame: OrderedFrame, keys: Sequence[str]) -> tuple[DataFrame, str]:
    """The data with the number of the run of equal consecutive keys that each row lies in."""
    if not frame.ordering.ordered:
        raise Invalid("segments need ordered input")
    data, chunk = chunked(frame)
    key = F.struct(*[F.col(quoted(k)) for k in keys])
    w = Window.partitionBy(chunk).orderBy(SEQ)
    opens = F.when(F.row_number().over(w) == 1, 0).when(F.lag(key).over(w).eqNullSafe(key), 0).otherwise(1)
    local = data.withColumn("__opens", opens).withColumn("__local", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.drop("__opens")
    # one row per chunk: its first and last key and its number of runs
    per = local.groupBy(chunk).agg(F.min_by(key, SEQ).alias("head"), F.max_by(key, SEQ).alias("tail"), (F.max("__local") + 1).alias("runs"))
    line = Window.orderBy(chunk)
    goes_on = F.lag("tail").over(line).eqNullSafe(F.col("head")) & (F.row_number().over(line) > 1)
    per = per.withColumn("fresh", F.col("runs") - F.when(goes_on, 1).otherwise(0))
    before = F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs")
    per = per.select(F.col(chunk).alias("__of"), before.alias("__before"))
    out = local.join(F.broadcast(per), F.col(chunk) == F.col("__of"))  # at most four times the shuffle partitions
    name = "__segment"
    return out.withColumn(name, F.col("__local") + F.col("__before")).drop(chunk, "__of", "__local", "__before"), name
