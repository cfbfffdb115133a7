"""Prediction and savings errors, and the reports made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.functions import metrics
from hearthgrid.functions.lookup import relabel
from hearthgrid.functions.text import prettify
from hearthgrid.operators.quantiles import grouped_quantiles
from hearthgrid.session import join_settled

KEYS = ("building_id", "upgrade_id", "building_set")
ATTRIBUTES = ("heating_fuel", "ac_type", "water_heater_fuel")
TOTAL = "total"
ERROR_COLUMNS = {
    "absolute_error": 0,
    "absolute_percentage_error": 1,
    "absolute_error_savings": 0,
    "absolute_percentage_error_savings": 1,
}
# Report headings, and the order of appliance types in the report.
HEADINGS = {
    "upgrade_id": "Upgrade ID",
    "type": "Type",
    "median_absolute_error": "Median Abs Error",
    "median_absolute_percentage_error": "Median APE",
    "mean_absolute_error": "Mean Abs Error",
    "mean_absolute_percentage_error": "Mean APE",
    "weighted_mean_absolute_percentage_error": "Weighted Mean APE",
    "median_absolute_error_savings": "Median Abs Error - Savings",
    "median_absolute_percentage_error_savings": "Median APE - Savings",
    "mean_absolute_error_savings": "Mean Abs Error - Savings",
    "mean_absolute_percentage_error_savings": "Mean APE - Savings",
    "weighted_mean_absolute_percentage_error_savings": "Weighted Mean APE - Savings",
}
TYPE_ORDER = (
    "Electricity",
    "Electric Resistance",
    "Natural Gas",
    "Propane",
    "Fuel Oil",
    "No Heating",
    "None",
    "Heat Pump",
    "AC",
    "Room AC",
    "No Cooling",
    "Total",
)


def unpivot_pairs(
    wide: DataFrame, ids: Sequence[str], values: Sequence[str], suffix: str = "-pred"
) -> DataFrame:
    """(ids, fuel, target_type, value) rows of actual and predicted columns."""
    # Inside the row, which keeps how the rows are dealt, as ``unpivot`` does not.
    rows = [
        F.struct(F.lit(v).alias("fuel"), F.lit(kind).alias("target_type"), F.col(f"`{v}{s}`").alias("value"))
        for kind, s in (("actual", ""), ("prediction", suffix))
        for v in values
    ]
    return wide.select(*ids, F.inline(F.array(*rows)))


def pivot_fixed(
    long: DataFrame, ids: Sequence[str], column: str, values: Sequence[str], value: str = "value"
) -> DataFrame:
    """One column per given value; one row per id and value is expected."""
    return long.groupBy(*ids).agg(
        *[F.max(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values]
    )


def by_fuel(
    wide: DataFrame, ids: Sequence[str], fuels: Sequence[str], parts: Mapping[str, str]
) -> DataFrame:
    """One row per fuel straight from the wide row.

    ``parts`` maps an output column to the suffix that its wide columns carry, so
    unpivot and pivot happen inside the row and nothing is shuffled.
    """
    rows = [
        F.struct(
            F.lit(fuel).alias("fuel"),
            *[F.col(f"`{fuel}{suffix}`").alias(name) for name, suffix in parts.items()],
        )
        for fuel in fuels
    ]
    return wide.select(*ids, F.inline(F.array(*rows)))


def with_baseline_values(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    columns: Mapping[str, Column | str],
) -> DataFrame:
    """Attach each group's values at its lowest ``order``.

    An aggregate folds on the map side and the join splits heavy groups, where a
    window would send a whole group to one task. Null is a group like any other.
    """
    values = [
        (F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()
    ]
    first = df.groupBy(*group).agg(F.min_by(F.struct(*values), order).alias("__first"))
    return join_settled(df, first.select(*group, "__first.*"), list(group))


def presentable_types() -> dict[str, Column]:
    """Heating and cooling labels as shown in reports."""
    return {
        "heating_fuel": F.when(F.col("ac_type") == "Heat Pump", "Heat Pump").otherwise(
            relabel(
                "heating_fuel", {"Electricity": "Electric Resistance", "None": "No Heating"}
            )
        ),
        "ac_type": relabel("ac_type", {"None": "No Cooling"}),
    }


def with_baselines(
    wide: DataFrame,
    fuels: Sequence[str],
    suffix: str = "-pred",
    extra_appliance: Mapping[float, str] | None = None,
) -> DataFrame:
    """Totals, report labels and the building's baseline values for every scenario row.

    ``wide`` has the keys, one actual and one predicted column per fuel, and the
    appliance attributes. Baselines are taken while the row is still wide, which
    shuffles each scenario once instead of once per fuel. ``extra_appliance`` maps
    further scenarios to the attribute that names their appliance.
    """
    # Predictions of fuels a home lacks are null and do not count towards its total.
    wide = wide.withColumns(
        {
            TOTAL: metrics.row_sum(fuels),
            TOTAL + suffix: metrics.row_sum(
                [F.col(f"`{f}{suffix}`") for f in fuels], ignore_null=True
            ),
            **presentable_types(),
        }
    )
    attribute_of = {6.0: "water_heater_fuel"} | dict(extra_appliance or {})
    attributes = dict.fromkeys(["heating_fuel", *attribute_of.values()])
    every = [*fuels, TOTAL]
    values = {
        **{f"{f}-base": F.col(f"`{f}`") for f in every},
        **{f"{f}{suffix}-base": F.col(f"`{f}{suffix}`") for f in every},
        **{f"base_{a}": F.col(a) for a in attributes},
        "baseline_ac_type": F.col("ac_type"),
    }
    # A building has a row for each scenario, so one sort brings them together, and none of
    # them is shuffled that is dealt by building already. An aggregate of a struct sorts
    # before and after its shuffle, and the rows once more to join it.
    first = Window.partitionBy("building_id", "building_set").orderBy(F.asc_nulls_last("upgrade_id"))
    found = F.struct(*[c.alias(name) for name, c in values.items()])
    based = wide.withColumn(
        "__first",
        F.first(F.when(F.col("upgrade_id").isNotNull(), found)).over(
            first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    ).select(*wide.columns, *[F.col("__first")[name].alias(name) for name in values])
    appliance = F.col("base_heating_fuel")
    for scenario, attribute in attribute_of.items():
        appliance = F.when(
            F.col("upgrade_id") == scenario, F.col(f"base_{attribute}")
        ).otherwise(appliance)
    energy = [f"`{f}{s}{b}`" for f in every for s in ("", suffix) for b in ("", "-base")]
    return based.select(
        *KEYS, appliance.alias("baseline_appliance"), "baseline_ac_type", *energy
    )


def errors_by_fuel(
    based: DataFrame, fuels: Sequence[str], suffix: str = "-pred", extra: Sequence[str] = ()
) -> DataFrame:
    """Errors of consumption and savings, one row per building, scenario and fuel.

    A projection of the rows of :func:`with_baselines`: settle those, not the five
    times as many rows that come out here.
    """
    rows = by_fuel(
        based,
        [*KEYS, "baseline_appliance", "baseline_ac_type", *extra],
        [*fuels, TOTAL],
        {
            "actual": "",
            "prediction": suffix,
            "actual_baseline": "-base",
            "prediction_baseline": f"{suffix}-base",
        },
    )
    return with_errors(with_savings(rows))


def with_savings(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "actual_savings": F.col("actual_baseline") - F.col("actual"),
            "prediction_savings": F.col("prediction_baseline") - F.col("prediction"),
        }
    )


def with_errors(rows: DataFrame, absolute_error: Column | None = None) -> DataFrame:
    """Absolute and percentage errors; the first baseline has no savings error."""
    if absolute_error is None:
        absolute_error = F.abs(F.col("prediction") - F.col("actual"))
    savings_error = F.when(
        F.col("upgrade_id") != 0, F.abs(F.col("prediction_savings") - F.col("actual_savings"))
    )
    return rows.withColumns(
        {"absolute_error": absolute_error, "absolute_error_savings": savings_error}
    ).withColumns(
        {
            "absolute_percentage_error": metrics.absolute_percentage_error(
                "absolute_error", "actual"
            ),
            "absolute_percentage_error_savings": metrics.absolute_percentage_error(
                "absolute_error_savings", "actual_savings"
            ),
        }
    )


def aggregate_metrics(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median, mean and weighted errors per group, rounded for the report."""
    weighted = {
        "weighted_mean_absolute_percentage_error": ("absolute_error", "actual"),
        "weighted_mean_absolute_percentage_error_savings": (
            "absolute_error_savings",
            "actual_savings",
        ),
    }
    medians = {f"median_{c}": (c, 0.5) for c in ERROR_COLUMNS}
    found = grouped_quantiles(
        errors,
        by,
        medians,
        extra=[
            *[F.round(F.avg(c), digits).alias(f"mean_{c}") for c, digits in ERROR_COLUMNS.items()],
            *[
                F.round(100 * metrics.weighted_error(e, a), 1).alias(name)
                for name, (e, a) in weighted.items()
            ],
        ],
    )
    return found.select(
        *by,
        *[F.round(f"median_{c}", digits).alias(f"median_{c}") for c, digits in ERROR_COLUMNS.items()],
        *[f"mean_{c}" for c in ERROR_COLUMNS],
        *weighted,
    )


def metric_report(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The four published groupings in one aggregation.

    Every error row is assigned to the report lines it counts for: its appliance
    type and scenario, its scenario, its cooling type if baseline, or its fuel.
    """
    is_total = F.col("fuel") == TOTAL
    scenario = F.col("upgrade_id").cast("string")
    cooling = F.col("baseline_ac_type")

    def line(grouping: str, kind: Column, label: Column, condition: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(grouping).alias("grouping"), kind.alias("type"), label.alias("upgrade_id")
            ),
        )

    lines = [
        line("heating", F.col("baseline_appliance"), scenario, is_total),
        line("total", F.lit("Total"), scenario, is_total),
        line(
            "cooling",
            cooling,
            scenario,
            is_total & (F.col("upgrade_id") == 0) & (cooling != "Heat Pump"),
        ),
        line(
            "fuel",
            prettify("fuel"),
            F.lit("Total By Fuel"),
            ~is_total & F.col("prediction").isNotNull(),
        ),
    ]
    assigned = errors.select(
        *by,
        *ERROR_COLUMNS,
        "actual",
        "actual_savings",
        F.inline(F.array(*lines)),
    ).where("grouping is not null")
    return aggregate_metrics(assigned, ["grouping", "type", "upgrade_id", *by]).drop("grouping")


def ordered_report(report: DataFrame) -> DataFrame:
    """Report with its headings, sorted by scenario and by the fixed type order."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("type"))
    return (
        report.orderBy("upgrade_id", F.when(rank > 0, rank).otherwise(len(TYPE_ORDER) + 1))
        .select(*[c for c in HEADINGS if c in report.columns])
        .withColumnsRenamed(HEADINGS)
    )


def by_model(
    rows: DataFrame, ids: Sequence[str], models: Mapping[str, Mapping[str, Column | str]]
) -> DataFrame:
    """One row per model, from columns that hold the models side by side.

    Replaces unpivoting arrays: each model lists the columns it is made of.
    """
    names = list(dict.fromkeys(n for parts in models.values() for n in parts))
    structs = [
        F.struct(
            F.lit(model).alias("model"),
            *[
                (
                    F.col(parts[n])
                    if isinstance(parts.get(n), str)
                    else parts.get(n, F.lit(None).cast("double"))
                ).alias(n)
                for n in names
            ],
        )
        for model, parts in models.items()
    ]
    return rows.select(*ids, F.inline(F.array(*structs)))


def benchmark_errors(errors: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Errors of the model and of a bucket benchmark in long form by ``model``.

    The benchmark has ``kwh_upgrade_median``, ``kwh_delta_median`` and its own
    ``absolute_error`` per building and scenario, for the total only. Its
    consumption error exists for the first baseline alone.
    """
    theirs = _benchmark_columns(benchmark).withColumn("fuel", F.lit(TOTAL))
    return _compared(errors.join(theirs, ["building_id", "upgrade_id", "fuel"], "left"))


def with_benchmark(based: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of :func:`with_baselines` with the benchmark's row of their building and scenario.

    Settle these for :func:`model_errors`: the join meets a row once, not once per fuel.
    """
    return based.join(_benchmark_columns(benchmark), ["building_id", "upgrade_id"], "left")


def model_errors(rows: DataFrame, fuels: Sequence[str], suffix: str = "-pred") -> DataFrame:
    """:func:`benchmark_errors` as a projection of the rows of :func:`with_benchmark`."""
    theirs = ("b_prediction", "b_savings", "b_error")
    long = errors_by_fuel(rows, fuels, suffix, theirs)
    return _compared(
        long.withColumns({c: F.when(F.col("fuel") == TOTAL, F.col(c)) for c in theirs})
    )


def _benchmark_columns(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        "building_id",
        "upgrade_id",
        F.col("kwh_upgrade_median").alias("b_prediction"),
        F.col("kwh_delta_median").alias("b_savings"),
        F.col("absolute_error").alias("b_error"),
    )


def _compared(joined: DataFrame) -> DataFrame:
    ids = [
        *KEYS,
        "fuel",
        "actual",
        "actual_savings",
        "baseline_appliance",
        "baseline_ac_type",
    ]
    long = by_model(
        joined,
        ids,
        {
            "Surrogate": {"prediction": "prediction", "prediction_savings": "prediction_savings"},
            "Bucketed": {
                "prediction": "b_prediction",
                "prediction_savings": "b_savings",
                "stored_error": "b_error",
            },
        },
    )
    own = F.abs(F.col("prediction") - F.col("actual"))
    stored = F.when(F.col("upgrade_id") == 0, F.col("stored_error"))
    return with_errors(long, F.when(F.col("model") == "Bucketed", stored).otherwise(own)).drop(
        "stored_error"
    )


def report_by_model(report: DataFrame, models: Sequence[str]) -> DataFrame:
    """Report with one column per metric and model."""
    measures = [c for c in report.columns if c not in ("type", "upgrade_id", "model")]
    return report.groupBy("upgrade_id", "type").agg(
        *[
            F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}|{m}")
            for c in measures
            for m in models
        ]
    )


def error_summary(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """Mean, exact median and count of each column per group."""
    return grouped_quantiles(
        df,
        by,
        {f"median_{c}": (c, 0.5) for c in columns},
        extra=[
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.count(c).alias(f"count_{c}") for c in columns],
            *extra,
        ],
    )


def value_spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median, standard deviation, minimum and maximum of a value per group."""
    return grouped_quantiles(
        df,
        by,
        {f"median_{value}": (value, 0.5)},
        extra=[
            F.avg(value).alias(f"mean_{value}"),
            F.stddev(value).alias(f"std_{value}"),
            F.min(value).alias(f"min_{value}"),
            F.max(value).alias(f"max_{value}"),
        ],
    )


def end_use_report(rows: DataFrame) -> DataFrame:
    """Older report: errors by end use and appliance type, and by end use alone.

    ``rows`` has ``end_use``, ``type``, ``actual`` and ``prediction``.
    """
    error = F.abs(F.col("prediction") - F.col("actual"))
    rows = rows.withColumns(
        {"abs_error": error, "percent_error": F.try_divide(error, F.col("actual")) * 100}
    )
    kinds = F.array(
        F.when(F.col("end_use") != "hvac", F.col("type")),
        F.lit("Total"),
    )
    assigned = rows.select(
        "end_use", "abs_error", "percent_error", F.explode(F.array_compact(kinds)).alias("type")
    )
    return grouped_quantiles(
        assigned,
        ["end_use", "type"],
        {"median_abs_error": ("abs_error", 0.5), "median_ape": ("percent_error", 0.5)},
        extra=[F.avg("abs_error").alias("mean_abs_error"), F.avg("percent_error").alias("mape")],
    )


def savings_by_building(
    rows: DataFrame, by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])
