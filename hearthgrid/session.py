"""Session settings, the shared work folder and joins of settled tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Methods beyond this size are never compiled by the JVM. Projections as wide as the
    # feature and scenario jobs run twice as fast as several smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture on every Column costs more than building these wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that a running session can still take."""
    for key, value in SESSION_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


_test_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, may fall
    back to a fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _test_folders:
        _test_folders[context.applicationId] = tempfile.mkdtemp(prefix="hearthgrid-")
    return _test_folders[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives executor loss, and gives the reader
    true file sizes, so the planner's own broadcast threshold applies to them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a wide or many-column aggregation that one task takes, about.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` in tasks of a bounded number of them.

    For aggregations by these keys and more, whose buffers are large: what a task holds does
    not grow with the table. Meant for keys of few rows each.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


def join_settled(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join a settled table on keys that may be null.

    The right side usually comes from a ``groupBy`` over the left, where null is a
    group like any other. No hint is given: the planner knows the size of the files
    and broadcasts them below its threshold, and beyond it the shuffle join is one
    that adaptive execution can split.
    """
    renamed = right.select(
        *[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns]
    )
    condition = F.lit(True)
    for key in on:
        condition = condition & left[key].eqNullSafe(renamed[f"__{key}"])
    return left.join(renamed, condition, how).drop(*[f"__{key}" for key in on])
