"""Files: the formats that Spark reads itself, and Arrow IPC through a distributed reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import Invalid
from ..ordering import OrderedFrame

FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")


def scan(spark: SparkSession, path: str | list[str], format: str = "parquet", schema=None, **options) -> OrderedFrame:  # noqa: A002
    """A dataset, with partitions found from its folders. Filters and columns are pushed into the scan by the planner."""
    if format == "ipc":
        return OrderedFrame.unordered(_ipc(spark, path, schema))
    if format not in FORMATS:
        raise Invalid(f"unknown format {format!r}")
    reader = spark.read.format(format).options(**options)
    return OrderedFrame.unordered((reader.schema(schema) if schema is not None else reader).load(path))


def _open(content: bytes) -> pa.RecordBatchReader | pa.RecordBatchFileReader:
    return pa.ipc.open_file(content) if content[:6] == b"ARROW1" else pa.ipc.open_stream(content)


def _ipc(spark: SparkSession, path, schema) -> DataFrame:
    """Arrow files and streams, one file per task step; only the first file's bytes come to the driver, for its schema."""
    files = spark.read.format("binaryFile").load(path)
    if schema is None:
        head = files.orderBy("path").select("content").first()
        if head is None:
            raise Invalid(f"no files in {path}")
        schema = from_arrow_schema(_open(bytes(head[0])).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with _open(content.as_py()) as reader:
                    if isinstance(reader, pa.RecordBatchFileReader):
                        yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
                    else:
                        yield from reader

    return files.select(F.col("content")).mapInArrow(read, schema)
