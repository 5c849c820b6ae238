"""Mixing sources to target weights, in DataFrame operations only.

1. Words per source are summed (partial sums before the shuffle, so a hot source is no hot task).
2. Sources are put in code-point order and get repeating weights. A word budget is shared by weight; a source
   stops at ``max_rate`` times its size and its excess is shared again by weight until none is above. That end
   state is ``target = min(cap, level * weight)``; ``level`` is found by rounds of one small aggregate each.
3. Every document is emitted ``floor(rate)`` times, plus once if a coin in [0, 1) that depends only on the seed, its
   id and its text is below the fraction of the rate. So different documents that share an id, or have none, draw
   coins of their own, and a source of them still comes near its target.

The list of sources is joined by broadcast only if it has at most ``broadcast_sources`` rows; a longer list is
joined by a shuffle, which adaptive execution splits where one source is hot.

Nulls and edge cases: a null text has size 0; null sources form one group, last in order; rows of one id (or
none) and one text share a coin; repeated rows each count and get the same number of copies; a source without words has target and rate 0;
an empty table gives an empty result. Other columns of the input are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, fresh, settle

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over seed, id and the text's MD5."""
    null = F.lit("null")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), null), F.lit(":"), F.coalesce(F.md5(text), null)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def ranked(sources: DataFrame, key: str, rank: str) -> DataFrame:
    """``sources`` with its 0-based place in code-point order, nulls last, without one task that sees all rows."""
    place, part, before, n = fresh(sources.columns, "_place", "_part", "_before", "_n")
    ordered = settle(sources.orderBy(F.col(key).asc_nulls_last()).withColumn(place, F.monotonically_increasing_id()))
    # the high bits of the id number the partition; there are as many rows here as partitions
    parts = ordered.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count("*").alias(n))
    before_part = F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(part, F.coalesce(before_part, F.lit(0)).alias(before))
    return (
        ordered.withColumn(part, F.shiftright(place, 33))
        .join(F.broadcast(parts), part)
        .withColumn(rank, F.col(before) + F.col(place).bitwiseAND((1 << 33) - 1))
        .drop(place, part, before)
    )


def source_targets(sized: DataFrame, source: str, size: str, share: float = 1.5, max_rate: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: ``source, source_size, weight, target, rate``."""
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    at = ranked(totals, "source", "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    at = settle(at.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_rate))).drop("_rank"))
    row = at.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weight = row[0] or 0, row[1] or 0
    budget, level, stopped = share * total, (share * total / all_weight if all_weight else 0.0), -1
    while all_weight:
        above = F.col("_cap") < F.lit(level) * F.col("weight")
        row = at.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if row[0] == stopped or not row[2]:
            break
        stopped, level = row[0], (budget - (row[1] or 0.0)) / row[2]
    target = F.least("_cap", F.lit(float(level)) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return at.withColumn("target", target).withColumn("rate", rate).drop("_cap")


def with_copies(docs: DataFrame, targets: DataFrame, source: str, drawn: Column, copies: str, broadcast_sources: int = 50_000) -> DataFrame:
    """``docs`` with its source's row of ``targets`` and the number of copies to emit; ``drawn`` is each row's coin."""
    small = targets.limit(broadcast_sources + 1).count() <= broadcast_sources
    targets = targets.withColumnRenamed("source", "_source")
    joined = docs.join(F.broadcast(targets) if small else targets, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
    whole = F.floor("rate")
    return joined.withColumn(copies, (whole + (drawn < F.col("rate") - whole).cast("long")).cast("long"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", share: float = 1.5, max_rate: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as its source's rate asks for, with ``copy`` from 1.

    Clashing names: the added column is called ``copy``, with underscores appended if ``docs`` has that already.
    """
    (size,) = fresh(docs.columns, "_size")
    targets = settle(source_targets(docs.select(source, word_count(F.col(text)).alias(size)), source, size, share, max_rate, weights))
    lean = targets.select("source", "rate")
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])  # no clash with our own names
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    counted = with_copies(inner, lean, at[source], coin(F.col(at[doc_id]), F.col(at[text]), seed), "_copies")
    many = counted.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    (copy,) = fresh(docs.columns, "copy")
    return many.select(*[F.col(at[c]).alias(c) for c in docs.columns], F.col("_copy").alias(copy))


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 0, **params) -> DataFrame:
    """Per document: id, size, its source's size and target, copies and words taken. The text is scanned once."""
    drawn = coin(F.col(doc_id), F.col(text), seed).alias("_coin")
    sized = settle(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("_src"), word_count(F.col(text)).alias("size"), drawn))
    targets = settle(source_targets(sized, "_src", "size", **params))
    out = with_copies(sized, targets, "_src", F.col("_coin"), "copies")
    return out.select("doc_id", "size", "source_size", F.col("target").cast(T.DoubleType()), (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op3(spark, sf_dir):
    from .common import table

    return mix_report(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][(rk % 3) + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM totals
), filled AS (
  SELECT *, row_number() OVER o AS k,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl
  FROM weighed WINDOW o AS (ORDER BY cap / weight, rk)
), level AS (
  SELECT arg_min(lvl, k) AS lev FROM filled WHERE lvl * weight <= cap
), targets AS (
  SELECT source, source_size, least(cap, lev * weight) AS target FROM filled, level
), rated AS (
  SELECT s.doc_id, s.size, s.coin, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM drawn
"""
