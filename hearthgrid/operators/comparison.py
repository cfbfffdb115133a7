"""Comparing versions of a report and scenarios with each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.operators.columns import quoted


def table_difference(previous: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New minus previous for every column, over all keys of either side."""
    measures = [c for c in previous.columns if c not in keys]
    if measures != [c for c in new.columns if c not in keys]:
        raise ValueError("both tables must have the same columns in the same order")
    old = previous.select(*map(quoted, keys), *[quoted(c).alias(f"{c}__old") for c in measures])
    return new.join(old, list(keys), "full").select(
        *map(quoted, keys), *[(quoted(c) - quoted(f"{c}__old")).alias(c) for c in measures]
    )


def stack_versions(versions: Mapping[str, DataFrame]) -> DataFrame:
    """All versions in one table with a ``version`` label."""
    stacked = None
    for name, df in versions.items():
        labelled = df.withColumn("version", F.lit(name))
        stacked = labelled if stacked is None else stacked.unionByName(labelled)
    return stacked


def comparable_errors(
    stacked: DataFrame, names: DataFrame, baselines: Sequence[float] = (0.0, 0.01)
) -> DataFrame:
    """Total errors of stacked versions, by scenario name and baseline fuel.

    Baselines keep their consumption error, other scenarios show the savings
    error. Home types that are not supported are left out.
    """
    error = F.when(
        F.col("upgrade_id").isin(list(baselines)), F.col("absolute_error")
    ).otherwise(F.col("absolute_error_savings"))
    kept = stacked.where(
        (F.col("fuel") == "total")
        & ~F.col("baseline_appliance").isin("Heat Pump", "No Heating")
    )
    return kept.join(names, "upgrade_id").select(
        "version",
        "building_id",
        "upgrade_id",
        F.concat("upgrade_name", F.lit(" ("), F.col("upgrade_id").cast("string"), F.lit(")")).alias(
            "upgrade_name"
        ),
        F.when(F.col("baseline_appliance") == "Electric Resistance", "Electricity")
        .otherwise(F.col("baseline_appliance"))
        .alias("baseline_fuel"),
        error.alias("absolute_error"),
    )


def _per_scenario(
    df: DataFrame,
    building: Sequence[str],
    scenario: str,
    scenarios: Sequence[float],
    columns: Sequence[str],
) -> DataFrame:
    """One row per building with one column per scenario and measure.

    Buffers as wide as the catalogue, folded on the map side: no list of a building's
    rows is ever gathered. A scenario outside the catalogue fails the job, and so does a
    building with several rows of one scenario: there is no one value to compare.
    """
    known = F.when(F.col(scenario).isin(list(scenarios)), F.col(scenario)).otherwise(
        F.raise_error(F.concat(F.lit("unknown scenario "), F.col(scenario).cast("string")))
    )
    checked = df.withColumn("__scenario", known)
    repeated = F.raise_error(F.concat(F.lit("several rows of one scenario: "), F.to_json(F.struct(*building))))

    def once(i: int) -> Column:
        return F.when(F.col(f"n__{i}") > 1, repeated).otherwise(F.col(f"n__{i}")).cast("long")

    counted = checked.groupBy(*building).agg(
        *[
            F.max(F.when(F.col("__scenario") == s, F.col(c))).alias(f"{c}__{i}")
            for i, s in enumerate(scenarios)
            for c in columns
        ],
        *[F.count_if(F.col("__scenario") == s).alias(f"n__{i}") for i, s in enumerate(scenarios)],
    )
    return counted.where(sum((once(i) for i in range(len(scenarios))), F.lit(0)) > 0)


def ordering_errors(
    df: DataFrame,
    building: Sequence[str],
    scenario: str,
    scenarios: Sequence[float],
    actual: str = "actual",
    prediction: str = "prediction",
) -> DataFrame:
    """Per building and scenario: comparisons made and comparisons predicted in the wrong order.

    Pairs are counted inside the building's row and never become rows.
    """
    wide = _per_scenario(
        df.withColumns({"__a": F.col(actual), "__p": F.col(prediction)}),
        building,
        scenario,
        scenarios,
        ["__a", "__p"],
    )
    present = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"n__{i}") > 0,
                    F.struct(
                        F.lit(s).alias(scenario),
                        F.col(f"__a__{i}").alias("a"),
                        F.col(f"__p__{i}").alias("p"),
                    ),
                )
                for i, s in enumerate(scenarios)
            ]
        )
    )

    def wrong(one):
        return F.size(
            F.filter("__all", lambda o: ((o["a"] - one["a"]) * (o["p"] - one["p"])) < 0)
        )

    counted = F.transform(
        "__all",
        lambda one: F.struct(
            one[scenario].alias(scenario),
            wrong(one).alias("n_wrong"),
            (F.size("__all") - 1).alias("n_compared"),
        ),
    )
    return (
        wide.select(*building, present.alias("__all"))
        .where(F.size("__all") > 1)
        .select(*building, F.inline(counted))
    )


def ordering_error_rates(errors: DataFrame, scenario: str) -> DataFrame:
    """Share of wrongly ordered comparisons per scenario."""
    return errors.groupBy(scenario).agg(
        (F.sum("n_wrong") / F.sum("n_compared")).alias("error_rate"),
        F.sum("n_compared").alias("occurrences"),
    )


def global_ordering_error(errors: DataFrame) -> DataFrame:
    """Share of wrongly ordered pairs; every pair was counted from both its ends."""
    return errors.agg(
        F.coalesce(F.try_divide(F.sum("n_wrong"), F.sum("n_compared")), F.lit(0.0)).alias(
            "error_rate"
        ),
        F.coalesce((F.sum("n_compared") / 2).cast("long"), F.lit(0)).alias("n_pairs"),
    )


def cross_scenario_trends(
    df: DataFrame,
    building: Sequence[str],
    scenario: str,
    scenarios: Sequence[float],
    actual: str = "actual",
    prediction: str = "prediction",
) -> DataFrame:
    """Trend of each scenario's actuals against every scenario's predictions.

    A model tells scenarios apart if the slope is nearest to one where the two
    scenarios agree. Predictions are attached as columns of the building, and the
    trend lines are plain aggregates over its rows. ``df`` is read twice: settle it
    first unless it is a table.
    """
    wide = _per_scenario(
        df.withColumn("__p", F.col(prediction)), building, scenario, scenarios, ["__p"]
    ).select(*building, *[f"__p__{i}" for i in range(len(scenarios))])
    fits = df.select(*building, scenario, actual).join(wide, list(building)).groupBy(scenario).agg(
        *[
            F.struct(
                F.lit(s).alias("predicted_scenario"),
                F.count(F.when(F.col(actual).isNotNull(), F.col(f"__p__{i}"))).alias("n_rows"),
                F.regr_slope(f"__p__{i}", actual).alias("slope"),
                F.regr_intercept(f"__p__{i}", actual).alias("intercept"),
            ).alias(f"fit_{i}")
            for i, s in enumerate(scenarios)
        ]
    )
    return fits.select(
        scenario, F.inline(F.array(*[f"fit_{i}" for i in range(len(scenarios))]))
    ).where("n_rows > 0")
