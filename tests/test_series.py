from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import calendar
from hearthgrid.operators import rollup, weather
from tests.conftest import values


def hourly(spark, hours=24 * 59):
    start = dt.datetime(2007, 1, 1)
    rows = [
        ("X", start + dt.timedelta(hours=h), float(h % 24), 2.0, float(h), 0.0, 0.0)
        for h in range(hours)
    ]
    return spark.createDataFrame(
        rows,
        "weather_file_city string, ts timestamp, temp_air double, wind_speed double, ghi double, dni double, dhi double",
    )


def test_arrays_are_in_hour_order(spark):
    df = hourly(spark).withColumn("datetime_formatted", F.date_format("ts", "MM-dd-HH:00"))
    shuffled = df.repartition(7, F.rand(1))
    row = weather.weather_arrays(shuffled, ["ghi", "temp_air"]).first()
    assert row["ghi"] == [float(h) for h in range(24 * 59)]
    assert row["temp_air"][25] == 1.0


def test_copies_of_an_hour_do_not_lengthen_the_year(spark):
    df = hourly(spark, 48).withColumn("datetime_formatted", F.date_format("ts", "MM-dd-HH:00"))
    row = weather.weather_arrays(df.unionByName(df), ["ghi"]).first()
    assert row["ghi"] == [float(h) for h in range(48)]


def test_time_slices(spark):
    df = spark.createDataFrame(
        [("X", [float(i) for i in range(8760)], list(range(8760)))],
        "city string, t array<double>, hours array<int>",
    )
    steps = weather.time_slices(df, ["t"], "M", ["city"]).orderBy("time_step").collect()
    assert [len(r["t"]) for r in steps] == [730] * 12
    assert steps[3]["t"][0] == 3 * 730
    days = weather.time_slices(df, ["t"], "D", ["city"])
    assert days.count() == 365


def test_no_hour_of_a_leap_year_is_lost(spark):
    labels = "date_format(timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id), 'MM-dd-HH:00')"
    df = spark.range(8784).selectExpr("'X' AS weather_file_city", "id + 0.0D AS t", f"{labels} AS datetime_formatted")
    arrays = weather.weather_arrays(df, ["t"], hours="hours")
    for grain, steps in (("D", 365), ("M", 12), ("Q", 4), ("Y", 1)):
        rows = weather.time_slices(arrays, ["t"], grain, ["weather_file_city"]).orderBy("time_step").collect()
        assert len(rows) == steps and [x for r in rows for x in r["t"]] == [float(i) for i in range(8784)]
        sums = spark.range(8784).selectExpr("'X' AS weather_file_city", "cast(id AS int) AS hour_index", "id AS t")
        summed = rollup.step_sums(sums, ["weather_file_city"], ["t"], grain)
        assert summed.count() == steps and summed.agg(F.sum("t")).first()[0] == 8783 * 8784 // 2
    # 29 February counts as the day before; the first of March is the 60th day.
    days = weather.time_slices(arrays, ["t"], "D", ["weather_file_city"]).orderBy("time_step").collect()
    assert len(days[58]["t"]) == 48 and days[59]["t"][0] == 60 * 24


@pytest.mark.parametrize("year", [2019, 2020, 2100, 2000])
def test_energy_and_weather_of_a_day_share_a_step(spark, year):
    start = f"timestamp'{year}-01-01 00:00:00'"
    df = spark.range(8784).selectExpr("'X' AS weather_file_city", "id + 0.0D AS t", f"{start} + make_interval(0, 0, 0, 0, id) AS ts")
    df = df.where(F.year("ts") == year).withColumn("hour_index", calendar.step_hour("ts"))
    keyed = df.withColumn("datetime_formatted", calendar.hour_key("ts"))
    assert keyed.where(calendar.label_hour("datetime_formatted") != F.col("hour_index")).isEmpty()
    arrays = weather.weather_arrays(keyed, ["t"], hours="hours")
    for grain in ("D", "M"):
        sums = rollup.step_sums(df, ["weather_file_city"], ["t"], grain)
        slices = weather.time_slices(arrays, ["t"], grain, ["weather_file_city"])
        wanted = {r["time_step"]: sum(r["t"]) for r in slices.collect()}
        assert {r["time_step"]: r["t"] for r in sums.collect()} == wanted


def test_hours_missing_from_a_year_move_no_other(spark):
    hours = [h for h in range(8760) if h % 100 > 30]
    df = spark.createDataFrame([("X", [float(h) for h in hours], hours)], "city string, t array<double>, hours array<int>")
    for row in weather.time_slices(df, ["t"], "D", ["city"]).collect():
        assert row["t"] == [float(h) for h in hours if h // 24 == row["time_step"]]


def test_one_station_per_city(spark):
    raw = spark.createDataFrame([("X", "G2"), ("X", "G1"), ("Y", "G3")], "city string, county string")
    stations = weather.one_key_per(raw, "city", "county", "county_gisjoin")
    readings = spark.createDataFrame(
        [("G1", "2007-01-06 05:00:00", 1.0), ("G2", "2007-01-06 05:00:00", 1.0), ("G3", "2007-01-05 23:00:00", 2.0)],
        "county_gisjoin string, date_time string, `Wind Speed [m/s]` double",
    )
    found = weather.hourly_weather(readings, stations.withColumnRenamed("city", "weather_file_city"))
    assert values(found, "weather_file_city", "wind_speed", "weekend", "datetime_formatted") == [
        ("X", 1.0, 1, "01-06-05:00"),
        ("Y", 2.0, 0, "01-05-23:00"),
    ]


def test_weather_rollups(spark):
    df = weather.degree_columns(hourly(spark)).withColumns(
        {"month": F.month("ts"), "day": F.dayofmonth("ts")}
    )
    daily = weather.weather_rollup(df, "weather_file_city", "daily")
    assert daily.count() == 59
    row = daily.where("month = 1 and day = 1").first()
    assert (row["temp_low"], row["temp_high"]) == (32.0, pytest.approx(23 * 1.8 + 32))
    assert (row["below_32"], row["below_41"]) == (0, 5)
    monthly = weather.weather_rollup(df, "weather_file_city", "monthly").orderBy("month").collect()
    assert [r["below_41"] for r in monthly] == [31 * 5, 28 * 5]
    assert monthly[0]["std_temp_high"] == pytest.approx(0.0)
    yearly = weather.weather_rollup(df, "weather_file_city", "yearly").first()
    assert yearly["below_41"] == 59 * 5
    with pytest.raises(ValueError, match="grain"):
        weather.weather_rollup(df, "weather_file_city", "weekly")


def test_summary_has_eight_numbers(spark):
    row = weather.weather_summary(hourly(spark)).first()
    assert len(row) == 9 and row["temp_max"] == 23.0


def energy(spark):
    rows = [
        (1, 0, 1, 1, 0, dt.datetime(2018, 1, 1, 0), 1.0, 10.0),
        (1, 0, 1, 1, 1, dt.datetime(2018, 1, 1, 1), 2.0, 20.0),
        (1, 0, 2, 1, 0, dt.datetime(2018, 2, 1, 0), 4.0, 40.0),
    ]
    return spark.createDataFrame(
        rows,
        "building_id int, upgrade_id int, month int, day int, hour int, timestamp timestamp, a double, b double",
    )


def test_energy_rollups(spark):
    assert values(rollup.energy_rollup(energy(spark), "yearly")) == [(1, 0, 7.0, 70.0)]
    assert values(rollup.energy_rollup(energy(spark), "monthly")) == [
        (1, 0, 1, 3.0, 30.0), (1, 0, 2, 4.0, 40.0),
    ]
    assert rollup.energy_rollup(energy(spark), "daily").columns == [
        "building_id", "upgrade_id", "month", "day", "sum_a", "sum_b",
    ]
    with pytest.raises(ValueError, match="grain"):
        rollup.energy_rollup(energy(spark), "hourly")


def test_energy_with_metadata_and_weather(spark):
    monthly = rollup.energy_rollup(energy(spark), "monthly")
    homes = spark.createDataFrame([(1, 0, "c")], "building_id int, upgrade_id int, county_geoid string")
    climate = spark.createDataFrame([("c", 1, 5.0), ("c", 3, 6.0)], "county_geoid string, month int, t double")
    joined = rollup.modelling_table(monthly, homes, climate, "monthly")
    assert values(joined, "month", "sum_a", "t") == [(1, 3.0, 5.0)]


def test_grouped_columns(spark):
    grouped = rollup.group_columns(energy(spark), {"total": ("a", "b"), "a": ("a",)})
    assert "b" not in grouped.columns and grouped.agg(F.sum("total")).first()[0] == 77.0


def test_period_end_stamps_move_to_the_hour_before(spark):
    rows = [(1, dt.datetime(2018, 1, 1, 0, m), 1.0) for m in (15, 30, 45)]
    rows += [(1, dt.datetime(2018, 1, 1, 1, 0), 1.0), (1, dt.datetime(2018, 1, 1, 1, 15), 1.0)]
    df = spark.createDataFrame(rows, "b int, timestamp timestamp, kwh double")
    found = rollup.hourly_from_period_end(df, ["b"], ["kwh"])
    assert [r["kwh"] for r in found.orderBy("hour_start").collect()] == [4.0, 1.0]


def test_step_sums(spark):
    df = spark.range(8760).select(
        F.lit(1).alias("b"), F.col("id").alias("hour_index"), F.lit(1).alias("kwh")
    )
    assert values(rollup.step_sums(df, ["b"], ["kwh"], "Q")) == [(1, q, 2190) for q in range(4)]


def test_bucket_benchmark_splits_scenario_eight(spark):
    schema = "building_id int, upgrade_id double, end_use string, kwh double"
    base = spark.createDataFrame([(1, 0.0, "hvac", 5.0), (1, 0.0, "dryer", 1.0)], schema)
    ups = spark.createDataFrame([(1, 8.0, "dryer", 2.0), (1, 8.0, "range", 3.0), (1, 8.0, "hvac", 4.0)], schema)
    found = rollup.split_bucket_benchmark(base, ups, ["kwh"])
    assert values(found) == [(1, 0.0, 6.0), (1, 8.0, 4.0), (1, 8.1, 2.0), (1, 8.2, 3.0)]
