"""Bulk column work: renaming, pruning, unit conversion, type reconciliation, filling.

Each operator computes its column mapping from the schema and applies it with one
``select``, so plans stay flat however wide the table is.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit factors.
KWH_PER_BTU = 0.00029307107
KG_PER_POUND = 0.45359237
# Name suffix -> (suffix in the new unit, conversion).
UNIT_SUFFIXES = {
    "_m_btu": ("_kwh", lambda c: c * (KWH_PER_BTU * 1e6)),
    "_lb": ("_kg", lambda c: c * KG_PER_POUND),
    "_btu_h": ("_kw", lambda c: c * KWH_PER_BTU),
    "_f": ("_c", lambda c: (c - 32) * 5 / 9),
}


def quoted(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def rename_all(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep and rename exactly the columns in ``names``, in its order."""
    return df.select(*[quoted(old).alias(new) for old, new in names.items()])


def edit_columns(
    df: DataFrame,
    drop_matching: Sequence[str] = (),
    strip: Sequence[str] = (),
    replace: Mapping[str, str] | None = None,
    dot: str = "__",
) -> DataFrame:
    """Replace dots, drop columns matching any pattern, then rewrite the names.

    Patterns are regular expressions. Replacements run in their given order and
    before the strips.
    """
    rewrites = {**(replace or {}), **dict.fromkeys(strip, "")}
    unwanted = re.compile("|".join(drop_matching)) if drop_matching else None
    names = {}
    for old in df.columns:
        undotted = old.replace(".", dot)
        if unwanted and unwanted.search(undotted):
            continue
        names[old] = reduce(lambda n, pr: re.sub(pr[0], pr[1], n), rewrites.items(), undotted)
    return rename_all(df, names)


def convert_units(df: DataFrame) -> DataFrame:
    """Convert columns to metric energy units by their name suffix and rename them."""

    def converted(name: str) -> Column:
        for suffix, (new_suffix, conversion) in UNIT_SUFFIXES.items():
            if name.endswith(suffix):
                return conversion(quoted(name)).alias(name.replace(suffix, new_suffix))
        return quoted(name)

    return df.select(*[converted(name) for name in df.columns])


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores for white space."""
    return df.toDF(*["_".join(name.lower().split()) for name in df.columns])


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str]) -> DataFrame:
    """Add ``suffix`` to every column but the keys."""
    return rename_all(df, {c: c if c in keep else c + suffix for c in df.columns})


def columns_like(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Keep ``keep`` and the columns whose whole name matches ``pattern``."""
    return df.select(*keep, df.colRegex(f"`{pattern}`"))


def reconcile_types(schemas: Sequence[T.StructType]) -> T.StructType:
    """Common type of every field that differs between schemas.

    Whole numbers meeting doubles, or meeting booleans, become doubles. Any other
    conflict is an error.
    """
    seen: dict[str, set[T.DataType]] = {}
    for schema in schemas:
        for field in schema.fields:
            seen.setdefault(field.name, set()).add(field.dataType)
    solvable = ({T.LongType(), T.DoubleType()}, {T.LongType(), T.BooleanType()})
    conflicts = {name: kinds for name, kinds in seen.items() if len(kinds) > 1}
    hopeless = {name: kinds for name, kinds in conflicts.items() if kinds not in solvable}
    if hopeless:
        raise ValueError(f"types that cannot be reconciled: {hopeless}")
    return T.StructType([T.StructField(name, T.DoubleType()) for name in conflicts])


def cast_to(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Cast the columns named in ``wanted``; booleans become 1.0 and 0.0."""
    kinds = {field.name: field.dataType for field in wanted.fields}

    def one(field: T.StructField) -> Column:
        kind = kinds.get(field.name, field.dataType)
        return quoted(field.name).cast(kind).alias(field.name) if kind != field.dataType else (
            quoted(field.name)
        )

    return df.select(*[one(field) for field in df.schema.fields])


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name after type reconciliation; columns absent from a table are null."""
    wanted = reconcile_types([t.schema for t in tables])
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [cast_to(t, wanted) for t in tables],
    )


def fill_from(df: DataFrame, source: str, columns: Sequence[str]) -> DataFrame:
    """Fill nulls of ``columns`` with the row's ``source`` value, keeping column order."""
    return df.select(
        *[
            F.coalesce(quoted(c), quoted(source)).alias(c) if c in columns else quoted(c)
            for c in df.columns
        ]
    )


def none_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn the label ``None`` into null."""
    return df.replace("None", None, subset=list(columns))
