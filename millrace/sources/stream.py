"""Unbounded sources: what a generator on the driver makes becomes a stream.

A queue cannot be read twice, so a stream over it could not repeat a micro-batch after a failure. The generator's
batches are therefore written to a folder in the order they come, and the stream reads that folder. The folder must be
one that all executors see.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Invalid
from .memory import _arrow_schema, _check_types, _frame


class Feed:
    """Writes batches to a folder from a thread of its own. ``finish`` waits for the end and raises what stopped it."""

    def __init__(self, spark: SparkSession, schema: pa.Schema, batches: Iterable[pa.RecordBatch], folder: str, sequence: str | None):
        self.spark, self.schema, self.batches, self.folder, self.sequence = spark, schema, batches, folder, sequence
        self.rows, self.error = 0, None
        self.thread = threading.Thread(target=self._run, name="millrace-feed", daemon=True)
        self.thread.start()

    def _run(self) -> None:
        try:
            for batch in self.batches:
                if not batch.schema.equals(self.schema, check_metadata=False):
                    raise Invalid(f"a batch has the schema {batch.schema}, not {self.schema}")
                if batch.num_rows:
                    self._write(batch)
        except BaseException as e:  # noqa: BLE001 - raised again by finish
            self.error = e

    def _write(self, batch: pa.RecordBatch) -> None:
        made = pa.Table.from_batches([batch])
        if self.sequence is not None:
            made = made.append_column(self.sequence, pa.array(range(self.rows, self.rows + batch.num_rows), pa.int64()))
        _frame(self.spark, made).coalesce(1).write.mode("append").parquet(self.folder)
        self.rows += batch.num_rows

    def finish(self, timeout: float | None = None) -> int:
        """The number of rows fed, once the generator has ended."""
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError("the generator has not ended")
        if self.error is not None:
            raise self.error
        return self.rows


def stream_source(spark: SparkSession, schema, generator: Iterable[pa.RecordBatch] | Callable[[], Iterable[pa.RecordBatch]], folder: str, sequence: str | None = None, batches_per_trigger: int | None = None) -> tuple[DataFrame, Feed]:
    """A stream of the generator's record batches, and its feed. ``sequence`` names a column of arrival numbers;
    ``batches_per_trigger`` bounds a micro-batch. Unsigned and dictionary columns arrive as Spark holds them."""
    arrow = _arrow_schema(schema)
    _check_types(arrow)
    if sequence is not None and sequence in arrow.names:
        raise Invalid(f"{sequence!r} is a column already")
    kept = _frame(spark, arrow.empty_table()).schema
    if sequence is not None:
        kept = kept.add(sequence, "long")
    _frame(spark, arrow.empty_table()).limit(0).select("*", *([F.lit(None).cast("long").alias(sequence)] if sequence else [])).write.mode("append").parquet(folder)
    reader = spark.readStream.schema(kept)
    if batches_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", batches_per_trigger)
    return reader.parquet(folder), Feed(spark, arrow, generator() if callable(generator) else generator, folder, sequence)
