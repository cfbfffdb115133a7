"""Checks over whole tables: categorical differences, null counts, profiles, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.operators.columns import quoted


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the given string columns."""
    pairs = [F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def column_difference(left: DataFrame, right: DataFrame) -> dict[str, set[str]]:
    """Column names found on one side only."""
    ours, theirs = set(left.columns), set(right.columns)
    return {"left only": ours - theirs, "right only": theirs - ours}


def categorical_difference(
    left: DataFrame, right: DataFrame, exclude: Sequence[str] = ()
) -> DataFrame:
    """Labels of shared string columns that occur on one side only.

    One aggregation over both sides: labels fold on the map side, so a label held
    by a third of all rows costs no more than a rare one.
    """
    shared = [c for c in string_columns(left, exclude) if c in string_columns(right, exclude)]
    tagged = (
        long_values(left, shared)
        .withColumn("in_left", F.lit(1))
        .withColumn("in_right", F.lit(0))
        .unionByName(
            long_values(right, shared)
            .withColumn("in_left", F.lit(0))
            .withColumn("in_right", F.lit(1))
        )
    )
    return (
        tagged.where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
        .where(F.col("in_left") != F.col("in_right"))
        .select(
            "column",
            "value",
            F.when(F.col("in_left") == 1, "left only").otherwise("right only").alias("side"),
        )
    )


def require_same_categories(
    left: DataFrame, right: DataFrame, exclude: Sequence[str] = ()
) -> None:
    """Fail if any shared string column has labels on one side only."""
    examples = categorical_difference(left, right, exclude).limit(20).collect()
    if examples:
        raise ValueError(f"labels found on one side only, for example: {examples}")


def null_counts(df: DataFrame) -> DataFrame:
    """Null count of every column as (column, n_null, n_rows), from one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("n_null"),
            F.col("__rows").alias("n_rows"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*pairs)))


def require_no_nulls(df: DataFrame) -> DataFrame:
    """Return ``df`` unchanged, or fail naming its columns that hold nulls."""
    holes = null_counts(df).where("n_null > 0").collect()
    if holes:
        raise ValueError(f"null values in {[(r['column'], r['n_null']) for r in holes]}")
    return df


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct) with labels folded before they are counted."""
    return (
        long_values(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )


def feature_profile(df: DataFrame, keys: Sequence[str] = ()) -> dict[str, int]:
    """Number of numeric and categorical features and the one-hot width of the table."""
    categorical = string_columns(df, keys)
    numeric = [c for c in df.columns if c not in categorical and c not in keys]
    widths = distinct_counts(df, categorical).agg(F.sum("n_distinct")).first()[0] or 0
    return {
        "numeric": len(numeric),
        "categorical": len(categorical),
        "dimensionality": len(numeric) + widths,
    }


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that are null or occur more than once."""
    incomplete = F.lit(False)
    for key in keys:
        incomplete = incomplete | quoted(key).isNull()
    return (
        df.groupBy(*[quoted(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where((F.col("n_rows") > 1) | incomplete)
    )


def require_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or fail if ``keys`` do not identify its rows."""
    examples = key_violations(df, keys).limit(5).collect()
    if examples:
        raise ValueError(f"{list(keys)} is not a key, for example: {examples}")
    return df
