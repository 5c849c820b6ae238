"""Typed rows to frames and back: type hints give the schema, ``Optional`` gives nullability, at every level."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..errors import Invalid
from ..ordering import OrderedFrame, quoted

_SIMPLE = {
    bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(),
    datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18),
}


def type_of(hint: Any) -> tuple[T.DataType, bool]:
    """The Spark type of a type hint, and whether it is nullable."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1 or len(rest) == len(args):
            raise TypeError(f"unsupported union {hint}")
        return type_of(rest[0])[0], True
    if isinstance(hint, T.DataType):
        return hint, False
    if hint in _SIMPLE:
        return _SIMPLE[hint], False
    if origin in (list, Sequence) or origin is tuple and len(args) == 2 and args[1] is Ellipsis:
        kind, null = type_of(args[0])
        return T.ArrayType(kind, null), False
    if origin is tuple and len(set(args)) == 1:  # a fixed number of one type; Spark keeps no length
        kind, null = type_of(args[0])
        return T.ArrayType(kind, null), False
    if origin is dict:
        kind, null = type_of(args[1])
        return T.MapType(type_of(args[0])[0], kind, null), False
    if dataclasses.is_dataclass(hint):
        return schema_of(hint), False
    raise TypeError(f"no Spark type for {hint}")


def schema_of(row: type | Sequence[Any], names: Sequence[str] | None = None) -> T.StructType:
    """The schema of a dataclass, or of a list of type hints with names."""
    if isinstance(row, type) and dataclasses.is_dataclass(row):
        hints = typing.get_type_hints(row)
        pairs = [(f.name, hints[f.name]) for f in dataclasses.fields(row)]
        if names is not None:
            if len(names) != len(pairs):
                raise Invalid(f"{len(names)} names for {len(pairs)} fields")
            pairs = [(n, h) for n, (_, h) in zip(names, pairs, strict=True)]
    else:
        if names is None or len(names) != len(row):
            raise Invalid("one name is needed for each type")
        pairs = list(zip(names, row, strict=True))
    return T.StructType([T.StructField(n, *type_of(h)) for n, h in pairs])


def _fixed(hint: Any, value: Any, where: str) -> None:
    if typing.get_origin(hint) is tuple and Ellipsis not in typing.get_args(hint) and value is not None and len(value) != len(typing.get_args(hint)):
        raise Invalid(f"{where}: {len(value)} items, not {len(typing.get_args(hint))}")


def _plain(value: Any) -> Any:
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return tuple(_plain(getattr(value, f.name)) for f in dataclasses.fields(value))
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def frame_from_rows(spark: SparkSession, rows: Iterable[Any], row: type | Sequence[Any], names: Sequence[str] | None = None) -> OrderedFrame:
    """Rows (dataclass instances or tuples) in implicit order. Missing values of non-optional fields are refused."""
    schema = schema_of(row, names)
    hints = list(typing.get_type_hints(row).values()) if isinstance(row, type) else list(row)
    made = []
    for r in rows:
        values = [getattr(r, f.name) for f in dataclasses.fields(r)] if dataclasses.is_dataclass(r) else list(r)
        if len(values) != len(schema):
            raise Invalid(f"a row has {len(values)} values, not {len(schema)}")
        for v, h, f in zip(values, hints, schema, strict=True):
            _fixed(h, v, f.name)
        made.append(tuple(_plain(v) for v in values))
    try:
        return OrderedFrame.implicit(spark.createDataFrame(made, schema))
    except Exception as e:
        if "NOT_NULLABLE" in str(e) or "not nullable" in str(e) or "CANNOT_BE_NONE" in str(e):
            raise Invalid(str(e)) from e
        raise


def rows_from_frame(frame: OrderedFrame, row: type | Sequence[Any], offset: int = 0, length: int | None = None) -> Iterator[Any]:
    """The rows in order, as ``row`` types; columns are matched by place and cast safely."""
    hints = list(typing.get_type_hints(row).values()) if isinstance(row, type) else list(row)
    if len(frame.columns) != len(hints):
        raise Invalid(f"{len(frame.columns)} columns for {len(hints)} types")
    data = frame.data.orderBy(*frame.order_columns()) if frame.ordering.ordered else frame.data
    kinds = [type_of(h) for h in hints]
    data = data.select(*[data[quoted(c)].cast(k) for c, (k, _) in zip(frame.columns, kinds, strict=True)]).offset(offset)
    for r in (data if length is None else data.limit(length)).toLocalIterator():
        for v, (_, null), c, h in zip(r, kinds, frame.columns, hints, strict=True):
            if v is None and not null:
                raise Invalid(f"{c!r} has a null but its type is not optional")
            _fixed(h, v, c)
        values = [_typed(v, h) for v, h in zip(r, hints, strict=True)]
        yield row(*values) if isinstance(row, type) else tuple(values)


def _typed(value: Any, hint: Any) -> Any:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if value is None:
        return None
    if origin in (typing.Union, types.UnionType):
        return _typed(value, next(a for a in args if a is not type(None)))
    if dataclasses.is_dataclass(hint):
        return hint(*[_typed(v, h) for v, h in zip(value, typing.get_type_hints(hint).values(), strict=True)])
    if origin in (list, tuple, Sequence):
        made = [_typed(v, args[0]) for v in value]
        return tuple(made) if origin is tuple else made
    return value
