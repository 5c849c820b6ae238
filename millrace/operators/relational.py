"""Operators that Spark has already, with the ordering carried along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..durable import settle
from ..errors import Invalid
from ..ordering import SEQ, OrderedFrame, Ordering, SortKey, quoted


def project(frame: OrderedFrame, columns: dict[str, Column | str]) -> OrderedFrame:
    """New columns by name; keys of an explicit ordering that are lost leave it implicit."""
    made = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    ordered = frame.ordering.ordered
    out = frame.data.select(*made, *([F.col(SEQ)] if ordered else []))
    kept = all(k.name in columns for k in frame.ordering.keys)
    return OrderedFrame(out, frame.ordering if kept else Ordering.implicit())


def order_by(frame: OrderedFrame, *keys: str | SortKey, nulls: str | None = None) -> OrderedFrame:
    """Declares a sort; it runs when rows are taken in order. Arrival breaks ties."""
    data = frame.data if frame.ordering.ordered else frame.data.withColumn(SEQ, F.monotonically_increasing_id())
    return OrderedFrame(data, Ordering.explicit(*keys, nulls=nulls), frame.non_null)


def fetch(frame: OrderedFrame, offset: int, count: int) -> OrderedFrame:
    """``count`` rows from ``offset`` on, in order."""
    if offset < 0 or count < 0:
        raise Invalid("offset and count must not be negative")
    return frame.with_data(frame.data.orderBy(*frame.order_columns()).offset(offset).limit(count))


def union(*frames: OrderedFrame) -> OrderedFrame:
    """All rows of all inputs, unordered."""
    out = frames[0].df
    for f in frames[1:]:
        out = out.unionByName(f.df)
    return OrderedFrame.unordered(out)


def intersect(left: OrderedFrame, right: OrderedFrame, every: bool = False) -> OrderedFrame:
    """Rows of both inputs, nulls equal; ``every`` keeps repeats as often as both have them."""
    return OrderedFrame.unordered(left.df.intersectAll(right.df) if every else left.df.intersect(right.df))


def subtract(left: OrderedFrame, right: OrderedFrame, every: bool = False) -> OrderedFrame:
    """Rows of the left input that the right one lacks; ``every`` takes away one row for each."""
    return OrderedFrame.unordered(left.df.exceptAll(right.df) if every else left.df.subtract(right.df))


def join(left: OrderedFrame, right: OrderedFrame, on: Sequence[str], how: str = "inner", null_safe: bool = False, broadcast_rows: int | None = None) -> OrderedFrame:
    """Equality join; the planner picks the strategy. With ``broadcast_rows`` the right side is broadcast if it is
    measured to have at most so many rows."""
    small = right.df
    if broadcast_rows is not None and small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        small = F.broadcast(small)
    if not null_safe:
        return OrderedFrame.unordered(left.df.join(small, list(on), how))
    renamed: DataFrame = small
    same = F.lit(True)
    for i, k in enumerate(on):
        renamed = renamed.withColumnRenamed(k, f"__k{i}")
        same = same & F.col(quoted(k)).eqNullSafe(F.col(f"__k{i}"))
    return OrderedFrame.unordered(left.df.join(renamed, same, how).drop(*[f"__k{i}" for i in range(len(on))]))


#: Pairs of rows that a cell of a theta join compares, and rows of a side that it holds, at most.
CELL_PAIRS = 1 << 25
_CELL_ROWS = 1 << 20
_MOST_TASKS = 100_000
_BROADCAST_KEYS = 10_000
_LEFT = ("left", "leftouter", "semi", "leftsemi", "anti", "leftanti")
_RIGHT = ("right", "rightouter")


def theta_join(left: OrderedFrame, right: OrderedFrame, condition: Column | str, on: Sequence[str] = (), how: str = "inner", small_rows: int = 10_000, cell_pairs: int = CELL_PAIRS) -> OrderedFrame:
    """Rows that meet a condition, beside equality on ``on``. Without ``on`` every pair is compared, so the right side
    must be counted to have at most ``small_rows`` rows and is broadcast; a larger one is refused.

    The work is the number of pairs of equal keys, whatever the bytes, so the pairs are counted first and dealt: a key of
    over ``cell_pairs`` becomes cells of a block of its left rows and a block of its right rows each, and tasks get about
    one cell. An inner join splits both sides, a left (right) one, semi and anti joins only the side whose rows must see
    all of the other, and a full one neither."""
    clash = (set(left.df.columns) & set(right.df.columns)) - set(on)
    if clash:
        raise Invalid(f"columns of both inputs: {sorted(clash)}")
    test = F.expr(condition) if isinstance(condition, str) else condition
    small = right.df
    if not on:
        if how not in ("inner", "left", "left_outer", "semi", "left_semi", "anti", "left_anti"):
            raise Invalid(f"a join without equality cannot be {how!r}")
        n = small.limit(small_rows + 1).count()
        if n > small_rows:
            raise Invalid(f"a join without equality needs a right side of at most {small_rows} rows")
        rows = left.df
        if n > 64:  # comparing a row costs more than moving it
            tasks = min(-(-rows.count() * n // cell_pairs), _MOST_TASKS)
            rows = rows.repartition(tasks) if tasks > 1 else rows
        return OrderedFrame.unordered(rows.join(F.broadcast(small), test, how))
    rows, small, dealt = _dealt(left.df, small, list(on), how, cell_pairs)
    renamed = small
    for i, k in enumerate(on):
        renamed = renamed.withColumnRenamed(k, f"__k{i}")
        if not dealt:
            test = test & (F.col(quoted(k)) == F.col(f"__k{i}"))
    for c in dealt:  # the keys are among them; by any other equality Spark would deal anew
        renamed = renamed.withColumnRenamed(c, f"{c}_")
        test = test & (F.col(c) == F.col(f"{c}_"))
    out = rows.join(renamed.hint("merge") if dealt else renamed, test, how)
    if how in ("right", "right_outer", "full", "outer", "full_outer"):
        for i, k in enumerate(on):
            out = out.withColumn(k, F.coalesce(F.col(quoted(k)), F.col(f"__k{i}")))
    return OrderedFrame.unordered(out.drop(*[f"__k{i}" for i in range(len(on))], *dealt, *[f"{c}_" for c in dealt]))


def _dealt(left: DataFrame, right: DataFrame, on: list[str], how: str, cell_pairs: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt to tasks of about ``cell_pairs`` pairs by columns that are equal where rows meet, and the names of
    these; the sides as they are and no names if there are no more pairs than that."""
    both = [[f.dataType for f in df.select(*map(quoted, on)).schema] for df in (left, right)]
    if any(x != y and not (isinstance(x, T.NumericType) and isinstance(y, T.NumericType)) for x, y in zip(*both, strict=True)):
        return left, right, []  # equality of such types is Spark's to say
    kind = how.lower().replace("_", "")
    own = [f"__on{i}" for i in range(len(on))]
    wider = left.select(*map(quoted, on)).union(right.select(*map(quoted, on))).schema.fields

    def key(k: str, kind: T.DataType) -> Column:
        c = F.col(quoted(k)).cast(kind)
        return F.when(c == 0, F.lit("0")).otherwise(c.cast("string")) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else c  # both zeros are equal

    def keyed(df: DataFrame) -> DataFrame:
        if kind == "inner":
            for k in on:
                df = df.filter(F.col(quoted(k)).isNotNull())
        return df.select("*", *[key(k, f.dataType).alias(o) for k, o, f in zip(on, own, wider, strict=True)])

    left, right = keyed(left), keyed(right)
    null = F.lit(False)
    for o in own:
        null = null | F.col(o).isNull()
    ones, none = F.lit(1), F.lit(0)
    sizes = left.select(*own, ones.alias("__l"), none.alias("__r")).union(right.select(*own, none, ones))
    sizes = sizes.groupBy(*own).agg(*[F.sum(n).cast("double").alias(n) for n in ("__l", "__r")])
    l, r, pairs = F.col("__l"), F.col("__r"), F.col("__pairs")
    sizes = sizes.withColumn("__pairs", F.when(null, 0.0).otherwise(l * r))
    share, side, whole = pairs / cell_pairs, float(cell_pairs) ** 0.5, F.lit(1.0)
    if kind == "inner":  # square cells move the fewest rows
        rows = F.greatest(F.when(r <= side, share).otherwise(l / side), l / _CELL_ROWS, whole)
        columns = F.greatest(share / F.col("__rows"), r / _CELL_ROWS, whole)
        sizes = sizes.filter(pairs > 0)
    else:
        rows = F.greatest(share, l / _CELL_ROWS, whole) if kind in _LEFT else whole
        columns = F.greatest(share, r / _CELL_ROWS, whole) if kind in _RIGHT else whole
    plan = sizes.withColumn("__rows", F.ceil(rows)).withColumn("__columns", F.ceil(columns))
    cells = F.col("__rows") * F.col("__columns")
    found = plan.agg(F.sum(pairs), F.sum(F.when(cells > 1, cells.cast("double")).otherwise(share)), F.sum(l + r), F.max(cells), F.sum(l * F.col("__columns")), F.sum(r * F.col("__rows"))).first()
    n_pairs, n_cells, n_rows, most, moved_left, moved_right = (x or 0 for x in found)
    if most <= 1 and n_pairs <= cell_pairs:
        return left.drop(*own), right.drop(*own), []
    plan = settle(plan.filter(cells > 1).select(*[F.col(o).alias(f"{o}_") for o in own], "__rows", "__columns"))
    if plan.count() <= _BROADCAST_KEYS:
        plan = F.broadcast(plan)
    tasks = min(max(int(2 * n_cells) + 1, int(n_rows) // _CELL_ROWS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), _MOST_TASKS)
    same = F.lit(True)
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"{o}_"))

    def deal(df: DataFrame, mine: str, other: str, moved: float) -> DataFrame:
        n, met = (F.coalesce(F.col(c), F.lit(1).cast("long")) for c in (mine, other))
        placed = df.join(plan, same, "left").select(*df.columns, n.alias("__block"), met.alias("__met"))
        if moved > _CELL_ROWS:  # a scan of few tasks would make all the copies in these
            placed = placed.repartition(min(int(moved // _CELL_ROWS) + 1, _MOST_TASKS))
        placed = placed.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__block")))
        # a row must stay in its block when a task runs again; it goes to every block of the other side, unless its key is null
        place = F.explode(F.when(null, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("__met") - 1)))
        return settle(placed).withColumn("__met", place).withColumnsRenamed({"__block": mine, "__met": other}).repartition(tasks, *dealt)

    dealt = [*own, "__rows", "__columns"]
    return deal(left, "__rows", "__columns", moved_left), deal(right, "__columns", "__rows", moved_right), dealt


def analytic(frame: OrderedFrame, columns: dict[str, Column | str], keys: Sequence[str] = (), rows: tuple[int, int] | None = None) -> OrderedFrame:
    """Window functions over each key's rows in the frame's order, all rows kept; ``rows`` bounds the window around each
    row. ``keys`` should split the data: one key's rows meet in one task."""
    if not frame.ordering.ordered:
        raise Invalid("window functions need ordered input")
    if not keys:
        raise Invalid("window functions need keys; aggregates over all rows are a scalar aggregate")
    over = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*frame.order_columns())
    framed = over if rows is None else over.rowsBetween(*rows)
    made = {n: (F.expr(c) if isinstance(c, str) else c).over(framed) for n, c in columns.items()}
    return frame.with_data(frame.data.withColumns(made))
