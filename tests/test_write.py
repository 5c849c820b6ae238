import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import Invalid, OrderedFrame, WriteOptions, tee, write


def rows(spark):
    df = spark.range(20).select(F.col("id").alias("x"), (F.col("id") % 2).alias("group")).coalesce(1).withMetadata("x", {"test": "preserved"})
    return OrderedFrame.implicit(df, by=["x"])


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_one_file_in_order(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    write(rows(spark), WriteOptions(path, preserve_order=True, max_rows_per_group=3))
    got = [r.x for f in files(path) for r in spark.read.parquet(f).collect()]
    assert got == list(range(20)) and spark.read.parquet(path).columns == ["x", "group"]


def test_partitioned_with_row_limit(spark, tmp_path):
    path = str(tmp_path / "b")
    out = tee(rows(spark), WriteOptions(path, partitioning=["group"], max_rows_per_file=4, max_rows_per_group=3))
    assert len(files(path)) == 6 and out.df.count() == 20
    for g in (0, 1):
        own = [f for f in files(path) if f"group={g}" in f]
        got = [r.x for f in sorted(own, key=lambda f: re.findall(r"c(\d+)", f)[-1]) for r in spark.read.parquet(f).collect()]
        assert got == list(range(g, 20, 2)) and spark.read.parquet(own[0]).columns == ["x"]
    with pytest.raises(Exception, match="(?i)exists"):
        write(rows(spark), WriteOptions(path, partitioning=["group"]))
    write(rows(spark), WriteOptions(path, partitioning=["group"], existing_data="overwrite_or_ignore"))
    assert spark.read.parquet(path).count() == 40
    half = rows(spark)
    write(half.with_data(half.data.filter("group = 1")), WriteOptions(path, partitioning=["group"], existing_data="delete_matching"))
    assert spark.read.parquet(path).groupBy("group").count().orderBy("group").collect() == [(0, 20), (1, 10)]


def test_schema_and_hooks(spark, tmp_path):
    def fail(path):
        raise OSError("hook")

    with pytest.raises(OSError, match="hook"):
        write(rows(spark), WriteOptions(str(tmp_path / "c"), post_finish=fail))
    named = T.StructType([T.StructField("y", T.LongType()), T.StructField("g", T.LongType())])
    out = tee(rows(spark), WriteOptions(str(tmp_path / "d"), custom_schema=named, partitioning=["group"]))
    assert out.columns == ["y", "g"] and spark.read.parquet(str(tmp_path / "d")).columns == ["y", "g"]
    write(rows(spark), WriteOptions(str(tmp_path / "e"), custom_metadata={"group": {"k": "v"}}))
    assert spark.read.parquet(str(tmp_path / "e")).schema["group"].metadata == {"k": "v"}


def test_options(spark, tmp_path):
    path, f = str(tmp_path / "z"), rows(spark)
    two = T.StructType([T.StructField("x", T.StringType()), T.StructField("group", T.LongType())])
    for bad in ({"max_rows_queued": 0}, {"partitioning": None}, {"max_partitions": 1, "partitioning": ["group"]}, {"min_rows_per_group": 5, "max_rows_per_group": 4}, {"basename_template": "a/{i}"}, {"basename_template": "a"}, {"existing_data": "x"}):
        with pytest.raises(Invalid):
            write(f, WriteOptions(path, **bad))
    with pytest.raises(TypeError):
        write(f, WriteOptions(path, custom_schema=two))
    with pytest.raises(TypeError):
        write(f, WriteOptions(path, custom_schema=f.schema, custom_metadata={}))
    with pytest.raises(Invalid):
        write(OrderedFrame.unordered(f.df), WriteOptions(path, preserve_order=True))
    with pytest.raises(KeyError):
        write(f, WriteOptions(path, partitioning=["missing"]))
    assert not os.path.exists(path)
