"""Filter with non-null refinement."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordering import OrderedFrame, quoted, top_level

_ZEROS = {
    T.StringType: "", T.BinaryType: b"", T.BooleanType: False, T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 0,
    T.FloatType: 0.0, T.DoubleType: 0.0, T.DateType: datetime.date(1970, 1, 1), T.TimestampType: datetime.datetime(1970, 1, 1),
}


def filter_rows(frame: OrderedFrame, predicate: Column | str | bool | None, not_null: tuple[str, ...] | list[str] = (), refine: str = "track") -> OrderedFrame:
    """Rows for which the predicate is true and no column of ``not_null`` is null. A null predicate drops all rows.

    The named columns become non-nullable in ``schema``. With ``refine="physical"`` the DataFrame's own schema says so
    too (a coalesce with a never-used value, which later filters cannot be pushed through); ``"track"`` keeps the plan
    free for pushdown and only records it.
    """
    df = frame.data
    fields = [top_level(df, name) for name in not_null]
    if predicate is None:
        predicate = F.lit(None).cast("boolean")
    elif isinstance(predicate, bool):
        predicate = F.lit(predicate)
    elif isinstance(predicate, str):
        predicate = F.expr(predicate)
    kind = df.select(predicate).schema[0].dataType
    if not isinstance(kind, (T.BooleanType, T.NullType)):
        raise TypeError(f"a filter needs a boolean predicate, not {kind.simpleString()}")
    for name in not_null:
        predicate = predicate & F.col(quoted(name)).isNotNull()
    df = df.filter(predicate)
    if refine == "physical":
        for f in fields:
            zero = _ZEROS.get(type(f.dataType), decimal.Decimal(0) if isinstance(f.dataType, T.DecimalType) else None)
            if zero is not None:
                df = df.withColumn(f.name, F.coalesce(F.col(quoted(f.name)), F.lit(zero).cast(f.dataType)))
    return OrderedFrame(df, frame.ordering, frame.non_null | set(not_null))
