"""Settings, stored intermediate tables and keys shared by these operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.session import fresh_path

# Rows a Python worker gets at once: texts are long, so fewer than by default.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and shuffle files that go when the query that made them ends.

    Results that are read again are stored tables, so no later query needs those files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def stored(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """``df`` as a table in the shared folder; its shuffle files go with the write."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def split_number(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def key_hash(key: Column) -> Column:
    """A number of 60 bits from a key's text, alike on every engine; null counts as a key."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
