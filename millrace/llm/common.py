"""Shared helpers of the corpus operators: table access, durable intermediate results, word rules."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..durable import settle as settle
from ..durable import shared_dir as shared_dir

#: A word is a maximal run of characters that are neither a space nor one of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that start like ``names`` and clash with none of ``taken``, ignoring case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written to the shared folder between the steps of one operator, removed at the end.

    ``keep`` writes Parquet (compressed, with sizes that the planner sees) and reads it back, which cuts lineage like
    a checkpoint: a lost executor costs a re-read. Shuffle files of steps that are over are released on the way.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove_path(self.spark, self.path)
        release(self.spark)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        schema = df.schema
        release(self.spark)
        return self.spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished steps' shuffles are unused; it removes their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
