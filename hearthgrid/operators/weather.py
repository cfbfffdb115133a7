"""Hourly weather: preparation, yearly arrays, calendar rollups and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import calendar

# Headers of the hourly weather files -> short names.
WEATHER_NAMES = {
    "Dry Bulb Temperature [°C]": "temp_air",
    "Relative Humidity [%]": "relative_humidity",
    "Wind Speed [m/s]": "wind_speed",
    "Wind Direction [Deg]": "wind_direction",
    "Global Horizontal Radiation [W/m2]": "ghi",
    "Direct Normal Radiation [W/m2]": "dni",
    "Diffuse Horizontal Radiation [W/m2]": "diffuse_horizontal_illum",
}


def one_key_per(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """The smallest ``key`` of each group, so that re-runs choose the same one."""
    return df.groupBy(group).agg(F.min(key).alias(name))


def hourly_weather(
    readings: DataFrame, stations: DataFrame, weekend_days: Sequence[int] = calendar.SATURDAY_SUNDAY
) -> DataFrame:
    """Readings of one county per weather city, with short names and calendar keys.

    ``readings`` has ``county_gisjoin`` and ``date_time``; ``stations`` maps one
    county to each ``weather_file_city``.
    """
    ts = F.col("date_time").cast("timestamp")
    return (
        readings.join(stations, "county_gisjoin")
        .withColumnsRenamed(WEATHER_NAMES)
        .withColumns(
            {
                "weekend": calendar.weekend(ts, weekend_days),
                "datetime_formatted": calendar.hour_key(ts),
            }
        )
        .drop("county_gisjoin", "date_time")
    )


def weather_arrays(
    hourly: DataFrame,
    variables: Sequence[str],
    city: str = "weather_file_city",
    hour: str = "datetime_formatted",
    hours: str | None = None,
) -> DataFrame:
    """One row per city with an hour-ordered array per variable.

    ``hour`` is a year-free label, so a city has at most 8784 of them. Readings
    that share an hour are averaged on the map side before any array is built,
    which bounds the arrays however many readings a city has. ``hours`` names an
    array with the hour of the year of every entry, for :func:`time_slices`.
    """
    slots = hourly.groupBy(city, hour).agg(*[F.avg(v).alias(v) for v in variables])
    ordered = F.array_sort(F.collect_list(F.struct(hour, *variables)))
    return (
        slots.groupBy(city)
        .agg(ordered.alias("__year"))
        .select(
            city,
            *[F.col(f"__year.{v}").alias(v) for v in variables],
            *([F.transform(f"__year.{hour}", calendar.label_hour).alias(hours)] if hours else []),
        )
    )


def time_slices(
    arrays: DataFrame,
    variables: Sequence[str],
    granularity: str,
    keys: Sequence[str],
    hours: str = "hours",
) -> DataFrame:
    """Arrays cut into the time steps of a year, one row per step.

    ``hours`` holds the hour of the year of every entry, in order. An entry goes to the
    step of its hour (:func:`calendar.time_step`), whatever other hours are missing;
    steps without hours have empty arrays. Nothing leaves the row.
    """
    steps = F.transform(hours, lambda hour: calendar.time_step(hour, granularity))
    placed = arrays.withColumn("__steps", steps).withColumn("__back", F.reverse("__steps"))

    def step(i):
        # Steps do not fall along the array, so the entries of one lie together.
        first = F.array_position("__steps", i).cast("int")
        last = F.size("__steps") + 1 - F.array_position("__back", i).cast("int")
        length = F.when(first > 0, last - first + 1).otherwise(0)
        parts = [F.slice(v, F.greatest(first, F.lit(1)), length).alias(v) for v in variables]
        return F.struct(i.alias("time_step"), *parts)

    numbers = F.sequence(F.lit(0), F.lit(calendar.STEPS_PER_YEAR[granularity] - 1))
    return placed.select(*keys, F.inline(F.transform(numbers, step)))


def degree_columns(hourly: DataFrame, celsius: str = "temp_air") -> DataFrame:
    """Temperature in Fahrenheit with cold-hour flags and degree values."""
    hot = calendar.celsius_to_fahrenheit(celsius)
    df = hourly.withColumn(celsius, hot)
    return df.withColumns(
        {
            "below_32": calendar.below(celsius, 32),
            "below_41": calendar.below(celsius, 41),
            "heating_degrees": calendar.heating_degrees(celsius),
            "cooling_degrees": calendar.cooling_degrees(celsius),
        }
    )


GRAINS = {"daily": ("month", "day"), "monthly": ("month",), "yearly": ()}
_MEANS = ("temp_high", "temp_low", "temp_avg", "wind_speed_avg", "ghi_avg", "dni_avg", "dhi_avg")
_SPREADS = {
    "std_temp_high": "temp_high",
    "std_temp_low": "temp_low",
    "std_wind_speed": "wind_speed_avg",
    "std_ghi": "ghi_avg",
}
_TOTALS = ("heating_degrees", "cooling_degrees", "below_41", "below_32")


def grain_keys(grain: str) -> tuple[str, ...]:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {sorted(GRAINS)}")
    return GRAINS[grain]


def weather_rollup(hourly: DataFrame, place: str, grain: str) -> DataFrame:
    """Daily weather per place, or means, spreads and totals of the days.

    Expects the columns of :func:`degree_columns` and ``wind_speed``, ``ghi``,
    ``dni``, ``dhi``, ``month``, ``day``.
    """
    keys = grain_keys(grain)
    daily = hourly.groupBy(place, *GRAINS["daily"]).agg(
        F.max("temp_air").alias("temp_high"),
        F.min("temp_air").alias("temp_low"),
        F.avg("temp_air").alias("temp_avg"),
        *[F.avg(c).alias(f"{c}_avg") for c in ("wind_speed", "ghi", "dni", "dhi")],
        *[F.avg(c).alias(c) for c in ("heating_degrees", "cooling_degrees")],
        *[F.sum(c).alias(c) for c in ("below_32", "below_41")],
    )
    if grain == "daily":
        return daily
    return daily.groupBy(place, *keys).agg(
        *[F.avg(c).alias(c) for c in _MEANS],
        *[F.stddev(c).alias(name) for name, c in _SPREADS.items()],
        *[F.sum(c).alias(c) for c in _TOTALS],
    )


def weather_summary(hourly: DataFrame, city: str = "weather_file_city") -> DataFrame:
    """Eight numbers per city that stand for its hourly year in a model."""
    fahrenheit = calendar.celsius_to_fahrenheit("temp_air")
    return hourly.groupBy(city).agg(
        F.avg("temp_air").alias("temp_mean"),
        F.stddev("temp_air").alias("temp_spread"),
        F.min("temp_air").alias("temp_min"),
        F.max("temp_air").alias("temp_max"),
        F.sum(calendar.heating_degrees(fahrenheit)).alias("heating_degree_hours"),
        F.sum(calendar.cooling_degrees(fahrenheit)).alias("cooling_degree_hours"),
        F.avg("wind_speed").alias("wind_mean"),
        F.avg("ghi").alias("ghi_mean"),
    )
