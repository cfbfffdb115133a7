"""Hourly energy to calendar grains, and joins of the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import calendar
from hearthgrid.functions.metrics import row_sum
from hearthgrid.operators.weather import grain_keys

CALENDAR_COLUMNS = ("month", "day", "hour", "weekday", "timestamp")
# Totals of the older energy tables and the columns they add up.
END_USE_GROUPS = {
    "out_electricity_heating_total": (
        "out_electricity_heating_fans_pumps_energy_consumption_kwh",
        "out_electricity_heating_hp_bkup_energy_consumption_kwh",
        "out_electricity_heating_energy_consumption_kwh",
    ),
    "out_electricity_cooling_total": (
        "out_electricity_cooling_fans_pumps_energy_consumption_kwh",
        "out_electricity_cooling_energy_consumption_kwh",
    ),
    "out_natural_gas_heating_total": (
        "out_natural_gas_heating_hp_bkup_energy_consumption_kwh",
        "out_natural_gas_heating_energy_consumption_kwh",
    ),
    "out_fuel_oil_heating_total": (
        "out_fuel_oil_heating_hp_bkup_energy_consumption_kwh",
        "out_fuel_oil_heating_energy_consumption_kwh",
    ),
    "out_propane_heating_total": (
        "out_propane_heating_hp_bkup_energy_consumption_kwh",
        "out_propane_heating_energy_consumption_kwh",
    ),
}
# Output groups of the oldest generation and their appliances.
APPLIANCE_GROUPS = {
    "heating": ("heating", "heating_fans_pumps", "heating_hp_bkup", "fireplace"),
    "cooling": ("cooling", "cooling_fans_pumps"),
    "lighting": ("lighting", "lighting_interior", "lighting_exterior", "lighting_garage"),
    "other": (
        "hot_tub_heater",
        "hot_tub_pump",
        "hot_water",
        "well_pump",
        "dishwasher",
        "freezer",
        "refrigerator",
        "grill",
        "range_oven",
        "ceiling_fan",
        "mech_vent",
        "pool_heater",
        "pool_pump",
        "clothes_dryer",
        "clothes_washer",
        "plug_loads",
    ),
}


def group_columns(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]],
    keep_parts: bool = False,
    ignore_null: bool = False,
) -> DataFrame:
    """Replace groups of columns by their row-wise sums."""
    parts = [c for members in groups.values() for c in members]
    summed = df.withColumns(
        {name: row_sum(members, ignore_null) for name, members in groups.items()}
    )
    return summed if keep_parts else summed.drop(*[c for c in parts if c not in groups])


def energy_rollup(
    hourly: DataFrame,
    grain: str,
    keys: Sequence[str] = ("building_id", "upgrade_id"),
    prefix: str = "sum_",
) -> DataFrame:
    """Sum of every measure by building, scenario and calendar grain."""
    by = [*keys, *grain_keys(grain)]
    measures = [c for c in hourly.columns if c not in (*keys, *CALENDAR_COLUMNS)]
    return hourly.groupBy(*by).agg(*[F.sum(c).alias(prefix + c) for c in measures])


def modelling_table(
    energy: DataFrame,
    metadata: DataFrame,
    weather: DataFrame,
    grain: str,
    place: str = "county_geoid",
    on: Sequence[str] = ("building_id", "upgrade_id"),
) -> DataFrame:
    """Rolled-up energy with building metadata and the weather of the same period.

    ``on`` names the keys that the metadata has: ``building_id`` alone if it does not
    differ by scenario.
    """
    return energy.join(metadata, list(on)).join(
        weather, [place, *grain_keys(grain)]
    )


def hourly_from_period_end(
    readings: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    ts: str = "timestamp",
    step_minutes: int = 15,
) -> DataFrame:
    """Sum period-end readings by the hour in which their period started."""
    start = F.col(ts) - F.expr(f"interval {step_minutes} minutes")
    return (
        readings.withColumn("hour_start", F.date_trunc("hour", start))
        .groupBy(*keys, "hour_start")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def step_sums(
    hourly: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    granularity: str,
    hour_index: str = "hour_index",
) -> DataFrame:
    """Sum of each measure by the time steps of :func:`calendar.time_step`.

    With hours from :func:`calendar.step_hour` the steps are those of
    :func:`weather.time_slices`, in leap years too.
    """
    step = calendar.time_step(hour_index, granularity).alias("time_step")
    return hourly.groupBy(*keys, step).agg(*[F.sum(m).alias(m) for m in measures])


def split_bucket_benchmark(
    baseline: DataFrame, upgrades: DataFrame, measures: Sequence[str]
) -> DataFrame:
    """Bucket predictions per building and scenario, with their baseline error.

    Scenario 8 becomes 8.1 for dryers and 8.2 for ranges.
    """
    scenario = F.col("upgrade_id")
    split = (
        F.when((scenario == 8) & (F.col("end_use") == "dryer"), 8.1)
        .when((scenario == 8) & (F.col("end_use") == "range"), 8.2)
        .otherwise(scenario)
    )
    return (
        baseline.unionByName(upgrades, allowMissingColumns=True)
        .withColumn("upgrade_id", split)
        .groupBy("building_id", "upgrade_id")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def bucket_predictions(buildings: DataFrame, buckets: DataFrame) -> DataFrame:
    """Attach to each building the prediction of its bucket."""
    b, p = buildings.alias("b"), buckets.alias("p")
    return b.join(p, F.col("b.bucket_id") == F.col("p.id")).drop("bucket_id", "id")
