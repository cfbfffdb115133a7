"""Raw inputs to the three extracted tables: metadata, annual outputs, hourly weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.operators.columns import quoted
from hearthgrid.operators.vintages import (
    SET_2022,
    SET_2024,
    align_vintages,
    clean_metadata,
    sampled_to_metadata,
)
from hearthgrid.operators.weather import hourly_weather, one_key_per
from hearthgrid.session import settle


def building_metadata(raw_2022: DataFrame, raw_2024: DataFrame) -> DataFrame:
    """Eligible buildings of both vintages with common columns and labels."""
    older = clean_metadata(raw_2022).withColumn("building_set", F.lit(SET_2022))
    newer = clean_metadata(raw_2024).withColumn("building_set", F.lit(SET_2024))
    return align_vintages(older, newer)


def sampled_metadata(samples: DataFrame, counties: DataFrame, building_set: str) -> DataFrame:
    """Sampled buildings, cleaned like simulated ones."""
    return clean_metadata(sampled_to_metadata(samples, counties)).withColumn(
        "building_set", F.lit(building_set)
    )


def annual_outputs(published: DataFrame, own_runs: DataFrame) -> DataFrame:
    """Published and own simulation outputs in one table.

    Own runs exist only where a scenario applies, so their flag is true.
    """
    flagged = own_runs.withColumn("applicability", F.lit(True))
    both = flagged.unionByName(published, allowMissingColumns=True)
    return both.withColumns(
        {
            "building_id": F.col("building_id").cast("int"),
            "upgrade_id": F.col("upgrade_id").cast("double"),
        }
    )


def weather_table(readings: DataFrame, raw_metadata: DataFrame, **options) -> DataFrame:
    """Hourly weather of one county per weather city.

    The station table is settled, so that its true size lets the planner broadcast it
    instead of shuffling the readings.
    """
    stations = one_key_per(
        raw_metadata.select(
            quoted("in.weather_file_city").alias("weather_file_city"),
            quoted("in.county").alias("county"),
        ),
        "weather_file_city",
        "county",
        "county_gisjoin",
    )
    return hourly_weather(readings, settle(stations, "stations"), **options)


