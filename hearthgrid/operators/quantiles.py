"""Exact quantiles per group by histogram refinement, without gathering any group.

Spark's exact ``median``/``percentile`` keep every distinct value of a group in one
buffer. Here a first pass counts each group's values by brackets that follow from the
value alone, with the least and the greatest value of each. The counts tell which bracket
holds a rank and how many values lie below it; only that bracket is opened. As long as it
holds more than ``SMALL`` values that differ, it is divided evenly between its least and its
greatest value and counted again. Then its values are ranked. Brackets hold their ranks by
their counts, so no data make a job fail or give another value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.session import join_settled, settle

# Values that one task ranks at most, unless they are all the same.
SMALL = 1_000_000
# First brackets for each factor of e in size, and parts of an opened bracket.
FIRST_PARTS = 64
PARTS = 4096
# Numbers beyond those of any finite double.
_INFINITE, _NOT_A_NUMBER = 100_000, 200_000


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, tuple[str, float]],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per group with exact, linearly interpolated quantiles.

    ``quantiles`` maps an output name to (value column, fraction). Null values do not
    count; NaN is greater than any number. ``extra`` aggregates are attached. One row for
    each group and quantile is stored, once, and again only for brackets that are opened
    further; the pass over the values inside brackets is part of the result's plan.
    """
    keys = list(keys)
    values = sorted({value for value, _ in quantiles.values()})
    valued = df.withColumns({f"__v_{v}": F.col(v).cast("double") for v in values})
    brackets = settle(_brackets(valued, keys, quantiles, values), "quantile-brackets")
    open_ = (F.col("__n") > SMALL) & (F.col("__low") < F.col("__high"))
    while not brackets.where(open_).isEmpty():
        divided = _divided(_inside(valued, brackets.where(open_), keys, quantiles), brackets, keys)
        brackets = settle(brackets.where(~open_).unionByName(divided), "quantile-brackets")
    ranked = _at_ranks(_inside(valued, brackets, keys, quantiles), brackets, keys)
    at = [F.max(F.when(F.col("__item") == i, F.col("__value"))).alias(f"__at_{i}") for i in range(2 * len(quantiles))]
    weights = [F.max(F.when(F.col("__item") == 2 * i, F.col("__weight"))).alias(f"__weight_{i}") for i in range(len(quantiles))]
    wide = ranked.groupBy(*keys).agg(*at, *weights).select(
        *keys, *[_between(f"__at_{2 * i}", f"__at_{2 * i + 1}", f"__weight_{i}").alias(n) for i, n in enumerate(quantiles)]
    )
    groups = df.groupBy(*keys).agg(*extra) if extra else df.select(*keys).distinct()
    return join_settled(groups, wide, keys, "left").select(*groups.columns, *quantiles)


def _between(lower: str, upper: str, weight: str) -> Column:
    step = F.when(F.col(weight) > 0, (F.col(upper) - F.col(lower)) * F.col(weight)).otherwise(0.0)
    return F.col(lower) + step


def _holding_rank(counted: DataFrame, group: Sequence[str], bracket: str) -> DataFrame:
    """The bracket that holds ``__rank``, with the number of values below. ``counted`` has a
    row for each bracket that has values, ``__base`` the number of values below all."""
    so_far = Window.partitionBy(*group).orderBy(bracket)
    before = F.sum("__n").over(so_far) - F.col("__n") + F.col("__base")
    holds = (F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__n"))
    rows = counted.withColumn("__before", before).where(holds)
    return rows.select(*group, "__rank", "__weight", "__low", "__high", "__before", "__n")


def _brackets(df: DataFrame, keys, quantiles, values) -> DataFrame:
    """Per group and item the rank and its first bracket.

    Each quantile has two items, the whole ranks next to fraction * (n - 1), and the weight
    of the upper one. First brackets grow with the size of their values; their number is
    bounded.
    """
    items = [F.struct(F.lit(i).alias("__column"), F.col(f"__v_{v}").alias("__value")) for i, v in enumerate(values)]
    v = F.col("__value")
    size = F.floor(F.log1p(F.abs(v)) * FIRST_PARTS)
    sign = F.signum(v)
    number = (
        F.when(F.isnan(v), _NOT_A_NUMBER)
        .when(F.abs(v) == float("inf"), sign * _INFINITE)
        .otherwise(sign * size)
        .cast("int")
    )
    counted = (
        df.select(*keys, F.inline(F.array(*items)))
        .where("__value is not null")
        .groupBy(*keys, "__column", number.alias("__bracket"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__value").alias("__low"), F.max("__value").alias("__high"))
    )
    asked = F.array(*[
        F.struct(F.lit(values.index(v)).alias("column"), F.lit(2 * i + side).alias("item"), F.lit(float(q)).alias("part"))
        for i, (v, q) in enumerate(quantiles.values()) for side in (0, 1)
    ])
    total = F.sum("__n").over(Window.partitionBy(*keys, "__column"))
    # Totals first: a window beside an explode would count exploded rows.
    each = counted.withColumn("__total", total).select(
        *keys, "__bracket", "__n", "__low", "__high", "__total", F.lit(0).cast("long").alias("__base"),
        F.explode(F.filter(asked, lambda a: a["column"] == F.col("__column"))).alias("__asked"),
    )
    place = F.col("__asked.part") * (F.col("__total") - 1)
    rank = F.when(F.col("__asked.item") % 2 == 0, F.floor(place)).otherwise(F.ceil(place))
    each = each.withColumns(
        {"__item": F.col("__asked.item"), "__rank": rank.cast("long"), "__weight": place - F.floor(place)}
    )
    return _holding_rank(each, [*keys, "__item"], "__bracket")


def _inside(df: DataFrame, brackets: DataFrame, keys, quantiles) -> DataFrame:
    """Values inside their group's brackets, with the number of their copies."""
    edges = brackets.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("__item") == i, F.struct("__low", "__high"))).alias(f"__edge_{i}")
            for i in range(2 * len(quantiles))
        ]
    )
    items, held = [], []
    for i, (value, _) in enumerate(v for v in quantiles.values() for _ in (0, 1)):
        v, edge = F.col(f"__v_{value}"), F.col(f"__edge_{i}")
        inside = (v >= edge["__low"]) & (v <= edge["__high"])
        items.append(F.struct(F.lit(i).alias("__item"), F.when(inside, v).alias("__value")))
        held.append(F.coalesce(inside, F.lit(False)))
    # Few rows have a value inside a bracket; only those are multiplied out.
    return (
        join_settled(df, edges, keys)
        .where(reduce(lambda a, b: a | b, held))
        .select(*keys, F.inline(F.array(*items)))
        .where("__value is not null")
        .groupBy(*keys, "__item", "__value")
        .agg(F.count(F.lit(1)).alias("__copies"))
    )


def _divided(inside: DataFrame, brackets: DataFrame, keys) -> DataFrame:
    """The part of each opened bracket that holds its rank.

    The least and the greatest value fall into different parts, so every round has fewer.
    """
    group = [*keys, "__item"]
    # Differences of the largest numbers are taken of their halves.
    scale = F.when(F.greatest(F.abs("__low"), F.abs("__high")) > 1e300, 0.5).otherwise(1.0)
    low, high, v = F.col("__low") * scale, F.col("__high") * scale, F.col("__value") * scale
    part = F.least(F.floor((v - low) / (high - low) * PARTS), F.lit(PARTS - 1)).cast("int")
    counted = (
        join_settled(inside, brackets, group)
        .groupBy(*group, "__rank", "__weight", F.col("__before").alias("__base"), part.alias("__part"))
        .agg(F.sum("__copies").alias("__n"), F.min("__value").alias("__low"), F.max("__value").alias("__high"))
    )
    return _holding_rank(counted, group, "__part")


def _at_ranks(inside: DataFrame, brackets: DataFrame, keys) -> DataFrame:
    """The value at each item's rank."""
    group = [*keys, "__item"]
    in_bracket = Window.partitionBy(*group).orderBy("__value")
    end = F.col("__before") + F.sum("__copies").over(in_bracket)
    ranked = join_settled(inside, brackets, group).withColumn("__end", end)
    holds = (F.col("__end") - F.col("__copies") <= F.col("__rank")) & (F.col("__rank") < F.col("__end"))
    return ranked.where(holds).select(*group, "__value", "__weight")


def percentile_band(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    low: float = 0.05,
    high: float = 0.95,
    strict: bool = False,
) -> DataFrame:
    """Rows whose value lies inside its group's percentile band."""
    bounds = settle(
        grouped_quantiles(df, keys, {"__band_low": (value, low), "__band_high": (value, high)}),
        "band",
    )
    v = F.col(value)
    inside = (
        (v > F.col("__band_low")) & (v < F.col("__band_high"))
        if strict
        else (v >= F.col("__band_low")) & (v <= F.col("__band_high"))
    )
    return join_settled(df, bounds, keys).where(inside).select(*df.columns)
