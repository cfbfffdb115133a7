"""Catalog tables with versioned names, keyed writes and exports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.operators.audit import require_key
from hearthgrid.operators.columns import suffix_columns

VERSION_SUFFIX = r"_(\d+_\d+_\d+)$"
# Rows, about so many, that tell the ranges of the columns a table is clustered by.
BOUND_ROWS = 10_000


def padded_version(version: str) -> str:
    """``1.2.3`` or ``1_2_3`` to ``01_02_03``; other text is returned as it is."""
    if re.fullmatch(r"\d+[._]\d+[._]\d+", version):
        return "_".join(f"{int(part):02}" for part in re.split(r"[._]", version))
    return version


def latest_versions(names: DataFrame, column: str, max_version: str | None = None) -> DataFrame:
    """(table_name, version) with the highest version of every versioned name."""
    version = F.regexp_extract(column, VERSION_SUFFIX, 1)
    versions = names.where(F.col(column).rlike(VERSION_SUFFIX)).select(
        F.regexp_replace(column, VERSION_SUFFIX, "").alias("table_name"),
        version.alias("version"),
    )
    if max_version is not None:
        versions = versions.where(F.col("version") <= padded_version(max_version))
    return versions.groupBy("table_name").agg(F.max("version").alias("version"))


def latest_table(
    spark: SparkSession, full_name: str, max_version: str | None = None, version_only: bool = False
) -> str | None:
    """Newest version of a catalog table, not above ``max_version``; None if there is none."""
    *namespace, table = full_name.split(".")
    if not namespace:
        raise ValueError("table names need a database: database.table or catalog.database.table")
    found = spark.sql(f"SHOW TABLES IN {'.'.join(namespace)}").select("tableName")
    row = (
        latest_versions(found, "tableName", max_version)
        .where(F.col("table_name") == table)
        .first()
    )
    if row is None:
        return None
    return row["version"] if version_only else ".".join([*namespace, f"{table}_{row['version']}"])


def query(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] = {}, **args) -> DataFrame:
    """SQL text over DataFrames given by name, with named parameter markers."""
    return spark.sql(text, args=args or None, **tables)


def save(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
) -> None:
    """Overwrite a managed table, its schema included.

    Tables bucketed alike by a unique key of whole numbers or text join on it without
    a shuffle. Keys with doubles are normalised by the join and shuffle all the same.
    """
    if bucket_by:
        df = df.repartition(buckets, *[F.col(c) for c in bucket_by])
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)


def save_partitioned(df: DataFrame, name: str, column: str) -> None:
    """Overwrite a managed table partitioned by one column."""
    save(balanced(df, [column]), name, [column])


def balanced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cluster rows by ``columns`` before a write.

    A rebalance, so that adaptive execution splits a value that holds a large part
    of all rows over several tasks, and joins small ones, by actual size.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns])


def save_keyed(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
) -> None:
    """Write a table whose keys are complete and unique, or fail and leave ``name`` as it was.

    The rows are computed once: they are written under another name, the written files are
    checked, and only then take the name.
    """
    spark = df.sparkSession
    waiting = f"{name}__{uuid.uuid4().hex[:12]}"
    save(df, waiting, bucket_by=bucket_by, buckets=buckets)
    try:
        require_key(spark.table(waiting), keys)
    except ValueError:
        spark.sql(f"DROP TABLE {waiting}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {waiting} RENAME TO {name}")


def wide_export(metadata: DataFrame, features: DataFrame, suffix: str = "__m") -> DataFrame:
    """Metadata, suffixed, next to the features of the same building."""
    return suffix_columns(metadata, suffix, ["building_id"]).join(features, "building_id")


def write_export(df: DataFrame, path: str, zone: str, cluster_by: Sequence[str]) -> None:
    """Parquet partitioned by an integer zone, sorted by the cluster columns in each file."""
    (
        balanced(df, [zone])
        .sortWithinPartitions(zone, *cluster_by)
        .write.mode("overwrite")
        .partitionBy(zone)
        .parquet(path)
    )


def cluster_bounds(df: DataFrame, columns: Sequence[str], bits: int = 6, rows: int = BOUND_ROWS) -> dict[str, list]:
    """For each column, values that cut it into at most ``2 ** bits`` ranges of about as many
    rows. They come from a sample of about ``rows`` rows and only tell where rows lie, so
    files hold the same rows whatever the sample."""
    total = df.count()
    sample = df.select(*columns)
    if total > rows:
        sample = sample.sample(rows / total, seed=0)
    # At most about ``rows`` values of each column; nulls are left out.
    values = sample.agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in columns]).first()
    bounds = {}
    for column in columns:
        found = values[column]
        cuts = [found[len(found) * i // 2**bits] for i in range(1, 2**bits)] if found else []
        # The least value bounds nothing.
        bounds[column] = [v for v in dict.fromkeys(cuts) if v != found[0]]
    return bounds


def range_number(column: str, bounds: Sequence) -> Column:
    """How many of the ascending ``bounds`` a value reaches, by halving; 0 for null."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) < F.lit(bounds[middle]), between(low, middle)).otherwise(
            between(middle + 1, high)
        )

    return F.when(F.col(column).isNull(), 0).otherwise(between(0, len(bounds)))


def interleaved(numbers: Sequence[Column], bits: int) -> Column:
    """One number from the digits of several: the leading digit of each, then the next."""
    if bits * len(numbers) > 63:
        raise ValueError("a key has 63 binary digits at most")
    key = F.lit(0).cast("long")
    for digit in reversed(range(bits)):
        for number in numbers:
            key = key * 2 + F.shiftright(number, digit).bitwiseAND(F.lit(1))
    return key


def write_clustered(
    df: DataFrame, path: str, zone: str, cluster_by: Sequence[str], bits: int = 6, files: int | None = None
) -> None:
    """Parquet partitioned by an integer zone, whose files are narrow in all cluster columns.

    Sorting by the columns one after another leaves files that span the last ones whole.
    Here the range numbers of all columns are interleaved digit by digit, and rows are
    dealt in ranges of that key, so a filter on any one column skips files. Rows of one key
    are dealt on by a hash of their columns, so no key goes to one task as long as its rows
    differ. ``files`` is the number of ranges, by default that of the session.

    ``df`` is read four times (its count, the sample, the ranges and the rows): pass a
    stored table.
    """
    bounds = cluster_bounds(df, cluster_by, bits)
    ranks = {f"__rank_{i}": range_number(c, bounds[c]) for i, c in enumerate(cluster_by)}
    # A column of few values takes as many leading digits as one of many.
    numbers = [
        F.floor(F.col(f"__rank_{i}") * 2**bits / (len(bounds[c]) + 1)).cast("int")
        for i, c in enumerate(cluster_by)
    ]
    # Maps have no hash; rows that differ in nothing else stay together.
    plain = [
        f"`{f.name}`" for f in df.schema.fields
        if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
    ]
    keyed = df.withColumns(ranks).withColumn("__cluster", interleaved(numbers, bits)).drop(*ranks)
    order = [F.col(zone), F.col("__cluster"), F.xxhash64(*[F.col(c) for c in plain])]
    dealt = keyed.repartitionByRange(*([files] if files else []), *order)
    (
        dealt.sortWithinPartitions(zone, "__cluster")
        .drop("__cluster")
        .write.mode("overwrite")
        .partitionBy(zone)
        .parquet(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """One CSV file of an aggregated report, in the order of its rows."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
