"""Whole jobs, and the shape of physical plans."""

from __future__ import annotations

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hearthgrid.operators import scenarios
from hearthgrid.plans import extract, feature_store, model
from hearthgrid.showcase import buildings
from hearthgrid.showcase.stock import raw_metadata
from tests.conftest import values


@pytest.fixture(scope="module")
def metadata(spark, folder):
    return buildings.aligned(spark, folder)


@pytest.fixture(scope="module")
def hourly(spark):
    cities = spark.createDataFrame([(f"City {c}",) for c in "ABCDE"], "weather_file_city string")
    return cities.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("h")
    ).select(
        "weather_file_city",
        F.format_string("01-%02d-%02d:00", F.floor(F.col("h") / 24) + 1, F.col("h") % 24).alias("datetime_formatted"),
        (F.col("h") * 0.5).alias("temp_air"),
        F.lit(3.0).alias("wind_speed"),
        F.col("h").cast("double").alias("ghi"),
        F.lit(0).alias("weekend"),
    )


@pytest.fixture(scope="module")
def feature_tables(metadata, hourly):
    return feature_store.feature_tables(metadata, hourly)


def test_feature_tables(feature_tables):
    features, weather = feature_tables
    assert {r["weather_file_city"]: r["weather_file_city_index"] for r in weather.collect()} == {
        f"City {c}": i for i, c in enumerate("ABCDE")
    }
    assert all(len(r["ghi"]) == 48 for r in weather.collect())
    assert features.where("upgrade_id = 0").count() > 0
    assert features.groupBy("building_id", "upgrade_id").count().where("count > 1").isEmpty()


def test_null_features_are_refused(metadata, hourly):
    with pytest.raises(ValueError, match="null values"):
        feature_store.feature_tables(metadata.withColumn("roof_material", F.lit(None).cast("string")), hourly)


def test_sampled_features_must_know_their_labels(spark, folder, metadata, feature_tables, hourly):
    features, _ = feature_tables
    later = metadata.where("building_set = 'ResStock 2024.2'").withColumn("building_set", F.lit("Sampled"))
    odd = later.withColumn("roof_material", F.lit("Thatch"))
    with pytest.raises(ValueError, match="one side"):
        feature_store.sampled_features(odd, features, hourly)


def outputs(features):
    size = F.col("n_bedrooms") * 1000.0
    return features.select(
        "building_id",
        "upgrade_id",
        *[
            F.when(F.lit(fuel == "electricity") | F.col(f"has_{fuel}_appliance"), size + i * 10)
            .otherwise(0.0)
            .alias(f"out_{fuel}_total_energy_consumption_kwh")
            for i, fuel in enumerate(("electricity", "natural_gas", "fuel_oil", "propane"))
            if fuel != "electricity"
        ],
        size.alias("out_electricity_total_energy_consumption_kwh"),
    )


def test_training_to_report(feature_tables, hourly):
    features, _ = feature_tables
    names = ["n_bedrooms", "heating_fuel", "has_ducts"]
    flags = ["has_natural_gas_appliance", "has_fuel_oil_appliance", "has_propane_appliance"]
    split = model.split_rows(outputs(features), features)
    assert split.select("building_set").distinct().count() == 2
    rows = model.model_rows(split, features, hourly, [*names, "ac_type", "water_heater_fuel", *flags])
    models = model.train_models(
        rows, [*names, "temp_mean"], list(scenarios.CATALOGUE), regressor=LinearRegression(regParam=0.1)
    )
    errors, report = model.evaluate(model.score_rows(models, rows.where("split <> 'train'")))
    assert errors.where("fuel = 'total'").agg(F.avg("absolute_percentage_error")).first()[0] < 25
    totals = {r["upgrade_id"] for r in report.where("type = 'Total'").collect()}
    assert {"0.0", "0.01"} <= totals


def test_annual_outputs(spark):
    published = spark.createDataFrame([(1, 3, True)], "building_id long, upgrade_id int, applicability boolean")
    own = spark.createDataFrame([(2, 11.05, 7.0)], "building_id long, upgrade_id double, extra double")
    both = extract.annual_outputs(published, own)
    assert values(both, "building_id", "upgrade_id", "applicability", "extra") == [
        (1, 3.0, True, None), (2, 11.05, True, 7.0),
    ]
    assert dict(both.dtypes)["building_id"] == "int"


def test_weather_reads_one_county_per_city(spark, folder):
    raw = raw_metadata(spark, folder, 2022, every=True)
    readings = raw.select(F.col("`in.county`").alias("county_gisjoin")).distinct().select(
        "county_gisjoin", F.lit("2007-01-06 00:00:00").alias("date_time"), F.lit(1.0).alias("Wind Speed [m/s]")
    )
    table = extract.weather_table(readings, raw)
    assert values(table.select("weather_file_city")) == [(f"City {c}",) for c in "ABCDE"]
    assert {r["weekend"] for r in table.collect()} == {1}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "baseline_attributes", "ordering_error", "bucket_benchmark", "scenario_features", "applicable_scenarios",
    "label_scenarios", "energy_rollup_monthly", "degree_monthly", "weather_arrays", "training_targets",
    "presence_flags", "categorical_diff", "split_with_baseline", "version_diff", "unpivot_pivot_long",
]


@pytest.mark.parametrize("name", LAZY)
def test_plans_have_no_cross_join_and_no_python(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "EvalPython"):
        assert unwanted not in text
    assert "SinglePartition" not in text


def test_scan_reads_only_needed_columns(spark, folder):
    df = entry.queries()["energy_rollup_monthly"](spark, folder)
    scan = [line for line in plan(df).splitlines() if "FileScan" in line][0]
    assert "l_partkey" not in scan and "l_orderkey" in scan


def test_filters_reach_the_scan(spark, folder):
    df = entry.queries()["training_targets"](spark, folder)
    scans = [line for line in plan(df).splitlines() if "FileScan" in line]
    assert any("In(l_linenumber" in s or "l_linenumber" in s.split("PushedFilters")[-1] for s in scans) or any(
        "PushedFilters: [IsNotNull(o_orderstatus)" in s for s in scans
    )


def test_literal_tables_take_no_task_and_are_broadcast(spark):
    names = scenarios.catalogue(spark)
    assert "LocalTableScan" in plan(names)
    joined = spark.range(10).selectExpr("id", "cast(id as double) as upgrade_id").join(names, "upgrade_id")
    assert "BroadcastHashJoin" in plan(joined)
