"""Queries on weather and energy series. Events are hourly readings of a user's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import calendar
from hearthgrid.operators import rollup, weather
from hearthgrid.showcase.base import Registry, table

registry = Registry()


def readings(spark, folder) -> DataFrame:
    """Events as weather readings: a temperature, wind and radiation per user and time."""
    events = table(spark, folder, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return events.select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        (cents % 600 / 10 - 20).alias("temp_air"),
        (cents % 128 / 8).alias("wind_speed"),
        (cents % 1000).cast("double").alias("ghi"),
        (cents % 64).cast("double").alias("dni"),
        (cents % 32).cast("double").alias("dhi"),
    )


READINGS = """
WITH r AS (SELECT event_id, user_id, ts, event_type, (round(value * 100)::BIGINT % 600)::DOUBLE / 10 - 20 AS temp_air,
  (round(value * 100)::BIGINT % 128)::DOUBLE / 8 AS wind_speed, (round(value * 100)::BIGINT % 1000)::DOUBLE AS ghi,
  (round(value * 100)::BIGINT % 64)::DOUBLE AS dni, (round(value * 100)::BIGINT % 32)::DOUBLE AS dhi FROM events)
"""


def _with_hour(spark, folder) -> DataFrame:
    return readings(spark, folder).withColumn("datetime_formatted", calendar.hour_key("ts"))


@registry.add(
    READINGS + ", s AS (SELECT user_id, strftime(ts, '%m-%d-%H:00') AS h, avg(ghi) AS ghi, avg(wind_speed) AS w FROM r GROUP BY ALL), "
    "a AS (SELECT user_id, list(ghi ORDER BY h) AS g, list(w ORDER BY h) AS w FROM s GROUP BY ALL) "
    "SELECT user_id, len(g) AS n_hours, round(g[1], 4) AS first, round(g[len(g)], 4) AS last, round(w[2], 4) AS second_wind FROM a"
)
def weather_arrays(spark, folder):
    arrays = weather.weather_arrays(
        _with_hour(spark, folder), ["ghi", "wind_speed"], city="user_id"
    )
    return arrays.select(
        "user_id",
        F.size("ghi").cast("long").alias("n_hours"),
        F.round(F.element_at("ghi", 1), 4).alias("first"),
        F.round(F.element_at("ghi", -1), 4).alias("last"),
        F.round(F.element_at("wind_speed", 2), 4).alias("second_wind"),
    )


@registry.add(
    READINGS + ", s AS (SELECT user_id, strftime(ts, '%m-%d-%H:00') AS h, avg(ghi) AS ghi FROM r GROUP BY ALL), "
    "a AS (SELECT user_id, dayofyear(('2001-' || CASE WHEN h LIKE '02-29%' THEN '02-28' ELSE h[1:5] END)::DATE) - 1 AS step, ghi FROM s) "
    "SELECT user_id, step::INTEGER AS time_step, count(*)::INTEGER AS n_hours, round(sum(ghi), 4) AS total FROM a GROUP BY ALL"
)
def time_slices(spark, folder):
    rows = _with_hour(spark, folder)
    arrays = weather.weather_arrays(rows, ["ghi"], city="user_id", hours="hours")
    steps = weather.time_slices(arrays, ["ghi"], "D", ["user_id"])
    return steps.where(F.size("ghi") > 0).select(
        "user_id",
        "time_step",
        F.size("ghi").alias("n_hours"),
        F.round(F.aggregate("ghi", F.lit(0.0), lambda total, x: total + x), 4).alias("total"),
    )


@registry.add(
    "SELECT event_id, (dayofweek(ts) IN (0, 6))::INTEGER AS weekend, (dayofweek(ts) IN (5, 6))::INTEGER AS friday_saturday, "
    "strftime(ts, '%m-%d-%H:00') AS hour_key, ((dayofyear(ts) - 1) * 24 + hour(ts))::INTEGER AS hour_index FROM events"
)
def weekend_flag(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        calendar.weekend("ts").alias("weekend"),
        calendar.weekend("ts", calendar.FRIDAY_SATURDAY).alias("friday_saturday"),
        calendar.hour_key("ts").alias("hour_key"),
        calendar.hour_of_year("ts").alias("hour_index"),
    )


@registry.add(
    READINGS + ", k AS (SELECT user_id % 10 AS city, min(user_id) AS user_id FROM r GROUP BY 1) "
    "SELECT city, strftime(ts, '%m-%d-%H:00') AS datetime_formatted, temp_air, (dayofweek(ts) IN (0, 6))::INTEGER AS weekend "
    "FROM r JOIN k USING (user_id)"
)
def dedupe_lookup_join(spark, folder):
    """One user's readings per city, in the form of the hourly weather table."""
    rows = readings(spark, folder).withColumn("city", F.col("user_id") % 10)
    stations = weather.one_key_per(rows, "city", "user_id", "county_gisjoin")
    files = rows.select(
        F.col("user_id").alias("county_gisjoin"),
        F.col("ts").alias("date_time"),
        F.col("temp_air").alias("Dry Bulb Temperature [°C]"),
    )
    hourly = weather.hourly_weather(files, stations)
    return hourly.select("city", "datetime_formatted", "temp_air", "weekend")


DEGREES = (
    READINGS
    + """
, f AS (SELECT *, temp_air * (9 / 5.0::DOUBLE) + 32 AS t, month(ts) AS m, day(ts) AS d FROM r),
daily AS (SELECT user_id, m, d, max(t) AS temp_high, min(t) AS temp_low, avg(t) AS temp_avg, avg(wind_speed) AS wind_speed_avg,
    avg(ghi) AS ghi_avg, avg(dni) AS dni_avg, avg(dhi) AS dhi_avg, avg(greatest(65 - t, 0)) AS heating_degrees,
    avg(greatest(t - 65, 0)) AS cooling_degrees, count(*) FILTER (t < 32) AS below_32, count(*) FILTER (t < 41) AS below_41
  FROM f GROUP BY ALL)
"""
)
DAILY = (
    "temp_high",
    "temp_low",
    "temp_avg",
    "wind_speed_avg",
    "ghi_avg",
    "dni_avg",
    "dhi_avg",
    "heating_degrees",
    "cooling_degrees",
)
SPREADS = ("std_temp_high", "std_temp_low", "std_wind_speed", "std_ghi")
ROLLED = (
    ", ".join(f"round(avg({c}), 6) AS {c}" for c in DAILY[:7])
    + ", round(sum(heating_degrees), 6) AS heating_degrees, round(sum(cooling_degrees), 6) AS cooling_degrees"
    + ", sum(below_41)::BIGINT AS below_41, sum(below_32)::BIGINT AS below_32"
    + "".join(
        f", coalesce(round(stddev({c}), 5), -1) AS {name}"
        for name, c in zip(SPREADS, ("temp_high", "temp_low", "wind_speed_avg", "ghi_avg"))
    )
)


def _rolled(spark, folder, grain: str) -> DataFrame:
    hourly = weather.degree_columns(readings(spark, folder)).withColumns(
        {"month": F.month("ts"), "day": F.dayofmonth("ts")}
    )
    done = weather.weather_rollup(hourly, "user_id", grain)
    done = done.withColumns({c: F.round(c, 6) for c in DAILY})
    if grain == "daily":
        return done
    return done.withColumns({c: F.coalesce(F.round(c, 5), F.lit(-1.0)) for c in SPREADS})


@registry.add(
    DEGREES + "SELECT user_id, m::INTEGER AS month, d::INTEGER AS day, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in DAILY)
    + ", below_32, below_41 FROM daily"
)
def degree_daily(spark, folder):
    return _rolled(spark, folder, "daily")


@registry.add(DEGREES + f"SELECT user_id, m::INTEGER AS month, {ROLLED} FROM daily GROUP BY user_id, m")
def degree_monthly(spark, folder):
    return _rolled(spark, folder, "monthly")


@registry.add(DEGREES + f"SELECT user_id, {ROLLED} FROM daily GROUP BY user_id")
def degree_yearly(spark, folder):
    return _rolled(spark, folder, "yearly")


@registry.add(
    READINGS + ", f AS (SELECT *, temp_air * (9 / 5.0::DOUBLE) + 32 AS t FROM r) "
    "SELECT user_id, round(avg(temp_air), 6) AS temp_mean, round(stddev(temp_air), 5) AS temp_spread, min(temp_air) AS temp_min, "
    "max(temp_air) AS temp_max, round(sum(greatest(65 - t, 0)), 4) AS heating_degree_hours, "
    "round(sum(greatest(t - 65, 0)), 4) AS cooling_degree_hours, round(avg(wind_speed), 6) AS wind_mean, "
    "round(avg(ghi), 6) AS ghi_mean FROM f GROUP BY user_id"
)
def weather_summary(spark, folder):
    found = weather.weather_summary(readings(spark, folder), "user_id")
    digits = {
        "temp_mean": 6,
        "temp_spread": 5,
        "heating_degree_hours": 4,
        "cooling_degree_hours": 4,
        "wind_mean": 6,
        "ghi_mean": 6,
    }
    return found.withColumns({c: F.round(c, d) for c, d in digits.items()})


END_USES = [c for members in rollup.END_USE_GROUPS.values() for c in members]
# Each end use takes another remainder of the price.
_USES = {c: f"round(l_extendedprice * 100)::BIGINT % {5 + i}" for i, c in enumerate(END_USES)}
_TOTALS = ", ".join(
    f"({' + '.join(_USES[c] for c in members)})::BIGINT AS {total}"
    for total, members in rollup.END_USE_GROUPS.items()
)
ENERGY = f"""
WITH h AS (SELECT l_orderkey AS building_id, l_linenumber AS upgrade_id, month(l_shipdate)::INTEGER AS month, day(l_shipdate)::INTEGER AS day,
    {_TOTALS} FROM lineitem)
"""
SUMS = ", ".join(f"sum({total})::BIGINT AS sum_{total}" for total in rollup.END_USE_GROUPS)


def hourly_energy(spark, folder) -> DataFrame:
    """Line items as hourly energy by end use, grouped into totals."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("building_id"),
        F.col("l_linenumber").alias("upgrade_id"),
        F.month("l_shipdate").alias("month"),
        F.dayofmonth("l_shipdate").alias("day"),
        F.col("l_shipdate").alias("timestamp"),
        *[(cents % (5 + i)).alias(c) for i, c in enumerate(END_USES)],
    )
    return rollup.group_columns(rows, rollup.END_USE_GROUPS)


@registry.add(ENERGY + f"SELECT building_id, upgrade_id, {SUMS} FROM h GROUP BY building_id, upgrade_id")
def energy_rollup_yearly(spark, folder):
    return rollup.energy_rollup(hourly_energy(spark, folder), "yearly")


@registry.add(
    ENERGY + f"SELECT building_id, upgrade_id, month, {SUMS} FROM h GROUP BY building_id, upgrade_id, month"
)
def energy_rollup_monthly(spark, folder):
    return rollup.energy_rollup(hourly_energy(spark, folder), "monthly")


@registry.add(
    ENERGY + f"SELECT building_id, upgrade_id, month, day, {SUMS} FROM h GROUP BY ALL"
)
def energy_rollup_daily(spark, folder):
    return rollup.energy_rollup(hourly_energy(spark, folder), "daily")


@registry.add(
    ENERGY + ", e AS (SELECT building_id, upgrade_id, month, sum(out_electricity_heating_total)::BIGINT AS heat FROM h GROUP BY ALL), "
    "w AS (SELECT c_nationkey AS place, 1 + (c_custkey % 12)::INTEGER AS month, round(avg(c_acctbal), 4) AS temp FROM customer GROUP BY ALL), "
    "m AS (SELECT o_orderkey AS building_id, c_nationkey AS place FROM orders JOIN customer ON c_custkey = o_custkey) "
    "SELECT place, e.month, count(*) AS n_rows, sum(heat)::BIGINT AS heat, round(avg(temp), 4) AS temp FROM e JOIN m USING (building_id) JOIN w "
    "ON w.place = m.place AND w.month = e.month GROUP BY ALL"
    .replace("SELECT place, e.month", "SELECT m.place, e.month")
)
def energy_with_weather(spark, folder):
    energy = rollup.energy_rollup(hourly_energy(spark, folder), "monthly")
    customers = table(spark, folder, "customer")
    homes = table(spark, folder, "orders").join(
        customers, F.col("c_custkey") == F.col("o_custkey")
    ).select(F.col("o_orderkey").alias("building_id"), F.col("c_nationkey").alias("place"))
    climate = customers.groupBy(
        F.col("c_nationkey").alias("place"),
        (1 + F.col("c_custkey") % 12).cast("int").alias("month"),
    ).agg(F.round(F.avg("c_acctbal"), 4).alias("temp"))
    joined = rollup.modelling_table(energy, homes, climate, "monthly", "place", ["building_id"])
    return joined.groupBy("place", "month").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("sum_out_electricity_heating_total").alias("heat"),
        F.round(F.avg("temp"), 4).alias("temp"),
    )


@registry.add(
    "SELECT user_id, (((dayofyear(('2001-' || CASE WHEN strftime(ts, '%m-%d') = '02-29' THEN '02-28' ELSE strftime(ts, '%m-%d') END)::DATE) - 1) * 24 "
    "+ hour(ts)) // 730)::INTEGER AS time_step, "
    "sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL"
)
def step_sums(spark, folder):
    events = table(spark, folder, "events").select(
        "user_id",
        calendar.step_hour("ts").alias("hour_index"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    return rollup.step_sums(events, ["user_id"], ["cents"], "M")


@registry.add(
    "SELECT user_id, strftime(date_trunc('hour', ts - INTERVAL 15 MINUTE), '%Y-%m-%d %H') AS hour, "
    "sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL"
)
def period_end_resample(spark, folder):
    events = table(spark, folder, "events").select(
        "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents")
    )
    hourly = rollup.hourly_from_period_end(events, ["user_id"], ["cents"], ts="ts")
    return hourly.select(
        "user_id", F.date_format("hour_start", "yyyy-MM-dd HH").alias("hour"), "cents"
    )


APPLIANCES = [a for members in rollup.APPLIANCE_GROUPS.values() for a in members]
# Each appliance takes another remainder of the price.
_PARTS = {a: f"round(l_extendedprice * 100)::BIGINT % {7 + i}" for i, a in enumerate(APPLIANCES)}


@registry.add(
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"({' + '.join(_PARTS[a] for a in members)})::BIGINT AS {group}"
        for group, members in rollup.APPLIANCE_GROUPS.items()
    )
    + " FROM lineitem"
)
def appliance_groups(spark, folder):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *[(cents % (7 + i)).alias(a) for i, a in enumerate(APPLIANCES)],
    )
    return rollup.group_columns(rows, rollup.APPLIANCE_GROUPS)
