"""Dataset write and write-through tee."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Invalid
from ..ordering import SEQ, OrderedFrame, quoted, top_level


@dataclass(frozen=True)
class WriteOptions:
    """``partitioning`` names the folder columns ([]: none). Existing data: ``error``, ``delete_matching``,
    ``overwrite_or_ignore`` (adds files). Row-group limits and ``max_open_files`` are checked but left to the format."""

    path: str
    partitioning: Sequence[str] | None = ()
    format: str = "parquet"
    max_partitions: int = 1024
    max_rows_per_file: int = 0
    min_rows_per_group: int = 0
    max_rows_per_group: int = 1 << 20
    max_open_files: int = 1024
    basename_template: str = "part-{i}"
    existing_data: str = "error"
    preserve_order: bool = False
    custom_schema: T.StructType | None = None
    custom_metadata: dict[str, dict] | None = None
    max_rows_queued: int = 8_388_608
    pre_finish: Callable[[str], None] | None = None
    post_finish: Callable[[str], None] | None = None
    format_options: dict[str, str] = field(default_factory=dict)


_MODES = {"error": "error", "delete_matching": "overwrite", "overwrite_or_ignore": "append"}


def _prepared(frame: OrderedFrame, o: WriteOptions) -> tuple[OrderedFrame, list[str]]:
    """The frame in the written schema, and its folder columns by their written names."""
    if o.partitioning is None:
        raise Invalid("partitioning is required; [] for none")
    if o.max_rows_queued <= 0:
        raise Invalid("max_rows_queued must be positive")
    if o.max_partitions <= 0 or o.max_open_files <= 0:
        raise Invalid("max_partitions and max_open_files must be positive")
    if o.max_rows_per_group <= 0 or o.min_rows_per_group > o.max_rows_per_group:
        raise Invalid("row-group limits contradict each other")
    if o.max_rows_per_file and o.max_rows_per_file < o.max_rows_per_group and o.max_rows_per_group != 1 << 20:
        raise Invalid("a file is smaller than a row group")
    if o.existing_data not in _MODES:
        raise Invalid(f"unknown rule for existing data {o.existing_data!r}")
    if "/" in o.basename_template or o.basename_template.count("{i}") != 1:
        raise Invalid("a basename template holds {i} once and no '/'")
    if o.basename_template != "part-{i}":
        warnings.warn("Spark names its files itself; basename_template is ignored", stacklevel=3)
    if o.preserve_order and not frame.ordering.ordered:
        raise Invalid("preserve_order needs ordered input")
    if o.custom_schema is not None and o.custom_metadata is not None:
        raise TypeError("give a custom schema or custom metadata, not both")
    for p in o.partitioning:
        top_level(frame.data, p)
    data, parts = frame.data, list(o.partitioning)
    if o.custom_schema is not None:
        old, new = frame.schema.fields, o.custom_schema.fields
        if [f.dataType for f in old] != [f.dataType for f in new]:
            raise TypeError("a custom schema may rename fields, not change their number or types")
        data = data.select(*[F.col(quoted(a.name)).alias(b.name, metadata=b.metadata or {}) for a, b in zip(old, new, strict=True)], *([F.col(SEQ)] if SEQ in data.columns else []))
        parts = [b.name for p in parts for a, b in zip(old, new, strict=True) if a.name == p]
    for name, meta in (o.custom_metadata or {}).items():
        data = data.withMetadata(name, meta)
    return frame.with_data(data), parts


def _write(frame: OrderedFrame, parts: list[str], o: WriteOptions) -> None:
    data = frame.df
    if parts:
        n = data.select(*[F.col(quoted(p)) for p in parts]).distinct().limit(o.max_partitions + 1).count()
        if n > o.max_partitions:
            raise Invalid(f"over {o.max_partitions} partitions")
    if o.preserve_order:
        # a global range sort: files in the order of their numbers are in the order of the rows
        order = [F.col(quoted(p)) for p in parts] + frame.order_columns()
        data = frame.data.orderBy(*order).drop(SEQ)
    writer = data.write.format(o.format).mode(_MODES[o.existing_data]).options(**o.format_options)
    if o.max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", o.max_rows_per_file)
    if parts:
        writer = writer.partitionBy(*parts).option("partitionOverwriteMode", "dynamic")
    if o.pre_finish:
        o.pre_finish(o.path)
    writer.save(o.path)
    if o.post_finish:
        o.post_finish(o.path)


def write(frame: OrderedFrame, options: WriteOptions) -> None:
    """Write all rows. Files appear when the job commits; a failing hook reaches the caller."""
    _write(*_prepared(frame, options), options)


def tee(frame: OrderedFrame, options: WriteOptions) -> OrderedFrame:
    """Write all rows and go on with them, in the written schema. The frame is persisted, so it is computed once."""
    ready, parts = _prepared(frame, options)
    held = ready.with_data(ready.data.persist(StorageLevel.MEMORY_AND_DISK))
    _write(held, parts, options)
    return held


def file_number(name: str) -> int:
    """The number in the name of one of Spark's part files."""
    found = re.search(r"part-(\d+)", name)
    if not found:
        raise Invalid(f"{name!r} is no part file")
    return int(found[1])
