"""In-memory and iterator sources.

All yield an ``OrderedFrame``. Bounded iterators are read on the driver, as the rows are there already; large data
belongs in files (``sources.files``). A batch whose schema differs from the declared one, or a column list of the wrong
length, raises instead of ending the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..errors import Invalid
from ..ordering import OrderedFrame, Ordering, SortKey


def _arrow_schema(schema: pa.Schema | T.StructType | str) -> pa.Schema:
    if schema is None:
        raise Invalid("a schema is required")
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return to_arrow_schema(schema) if isinstance(schema, T.StructType) else schema


def _check_types(schema: pa.Schema) -> None:
    """Refuse what Spark would lose without a word."""
    for f in schema:
        kind = f.type
        if pa.types.is_timestamp(kind) and kind.unit == "ns":
            raise NotImplementedError(f"{f.name}: nanosecond timestamps; Spark keeps microseconds")
        if pa.types.is_float16(kind):
            raise NotImplementedError(f"{f.name}: half floats")
        if pa.types.is_decimal(kind) and kind.precision > 38:
            raise NotImplementedError(f"{f.name}: decimals of over 38 digits")


def _frame(spark: SparkSession, table: pa.Table) -> DataFrame:
    _check_types(table.schema)
    columns = []
    for f in table.schema:
        column = table[f.name] if table.schema.names.count(f.name) == 1 else table.column(table.schema.get_field_index(f.name))
        if pa.types.is_dictionary(f.type):
            column = column.cast(f.type.value_type)
        elif pa.types.is_uint64(f.type):
            column = column.cast(pa.decimal128(20, 0))
        elif pa.types.is_unsigned_integer(f.type):
            column = column.cast({8: pa.int16(), 16: pa.int32(), 32: pa.int64()}[f.type.bit_width])
        columns.append(column)
    made = pa.table(columns, schema=pa.schema([pa.field(f.name, c.type, f.nullable, f.metadata) for f, c in zip(table.schema, columns, strict=True)]))
    schema = from_arrow_schema(made.schema)
    rows = spark.createDataFrame(made, schema=schema) if made.num_rows else spark.createDataFrame([], schema)
    return rows


def _ordered(df: DataFrame, ordering: Ordering | str) -> OrderedFrame:
    if isinstance(ordering, str):
        ordering = {"implicit": Ordering.implicit(), "unordered": Ordering.unordered()}[ordering]
    if ordering.kind == "unordered":
        return OrderedFrame.unordered(df)
    if ordering.kind == "implicit":
        return OrderedFrame.implicit(df)
    return OrderedFrame.explicit(df, *ordering.keys)


def table_source(spark: SparkSession, table: Any, max_batch_size: int | None = None) -> OrderedFrame:
    """An Arrow table or pandas frame, in implicit order. The batch size is checked; Spark sizes its own batches."""
    if table is None:
        raise Invalid("a table is required")
    if max_batch_size is not None and max_batch_size <= 0:
        raise Invalid("max_batch_size must be positive")
    if not isinstance(table, pa.Table):
        table = pa.Table.from_pandas(table, preserve_index=False)
    return _ordered(_frame(spark, table), Ordering.implicit())


def batch_source(spark: SparkSession, schema, batches: Iterable[pa.RecordBatch] | Callable[[], Iterable[pa.RecordBatch]], requires_io: bool = True, executor: object = None, ordering: Ordering | str = "implicit") -> OrderedFrame:
    """Record batches from an iterable, or from a function that makes one. Errors of the iterator reach the caller."""
    schema = _arrow_schema(schema)
    if executor is not None and not requires_io:
        raise Invalid("an executor is of use only with requires_io")
    held = []
    for batch in batches() if callable(batches) else batches:
        if not batch.schema.equals(schema, check_metadata=False):
            raise Invalid(f"a batch has the schema {batch.schema}, not {schema}")
        held.append(batch)
    return _ordered(_frame(spark, pa.Table.from_batches(held, schema)), ordering)


def record_batch_source(spark: SparkSession, schema, batches, requires_io: bool = True) -> OrderedFrame:
    return batch_source(spark, schema, batches, requires_io)


def exec_batch_source(spark: SparkSession, schema, batches: Iterable[Sequence] | Callable[[], Iterable[Sequence]], requires_io: bool = True) -> OrderedFrame:
    """Batches given as ``(columns, length)``; a column that is a scalar stands for ``length`` equal values."""
    arrow = _arrow_schema(schema)

    def made() -> Iterator[pa.RecordBatch]:
        for columns, length in batches() if callable(batches) else batches:
            if len(columns) != len(arrow):
                raise Invalid(f"a batch has {len(columns)} columns, not {len(arrow)}")
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) if isinstance(c, (list, tuple)) else pa.array([c] * length, f.type) for c, f in zip(columns, arrow, strict=True)]
            if any(len(a) != length for a in arrays):
                raise Invalid("columns of a batch differ in length")
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return batch_source(spark, arrow, made, requires_io)


def array_vector_source(spark: SparkSession, schema, vectors: Iterable[Sequence] | Callable[[], Iterable[Sequence]], requires_io: bool = True) -> OrderedFrame:
    """Batches given as lists of columns."""

    def sized():
        for columns in vectors() if callable(vectors) else vectors:
            if not len(columns):
                raise Invalid("a batch without columns")
            yield columns, len(columns[0])

    return exec_batch_source(spark, schema, sized, requires_io)


def reader_source(spark: SparkSession, reader: pa.RecordBatchReader | None, executor: object = None, implicit_ordering: bool = False) -> OrderedFrame:
    """A record batch reader; unordered unless asked for."""
    if reader is None:
        raise Invalid("a reader is required")
    return batch_source(spark, reader.schema, reader, ordering="implicit" if implicit_ordering else "unordered")


def source(spark: SparkSession, schema, generator: Iterable | Callable[[], Iterable], ordering: Ordering | str = "unordered") -> OrderedFrame:
    """A bounded generator of record batches with the ordering it declares. Unbounded ones: ``stream.stream_source``."""
    return batch_source(spark, schema, generator, ordering=ordering)


__all__ = ["SortKey", "array_vector_source", "batch_source", "exec_batch_source", "reader_source", "record_batch_source", "source", "table_source"]
