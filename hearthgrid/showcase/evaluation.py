"""Queries on prediction errors. Simulated outputs and predictions come from ``lineitem``.

An order is a building, a line number a scenario, a return flag a fuel. The
prediction is the discounted price. Amounts are added as whole hundredths of a
cent, so that sums are the same in whatever order they are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import metrics
from hearthgrid.operators import comparison, evaluation
from hearthgrid.operators.learning import FUELS
from hearthgrid.operators.quantiles import percentile_band as band
from hearthgrid.operators.rollup import bucket_predictions, split_bucket_benchmark
from hearthgrid.operators.scenarios import catalogue
from hearthgrid.session import dealt, settle
from hearthgrid.showcase.base import Registry, table

registry = Registry()

# Scenario of each line number, by building set.
IDS_2022 = (0.0, 1.0, 3.0, 4.0, 6.0, 9.0, 11.05)
IDS_2024 = (0.01, 11.07, 13.02, 15.04, 15.05, 15.06, 15.08)
FUEL_FLAGS = {"natural_gas": "A", "fuel_oil": "R", "propane": "N"}
HEATING = ("Natural Gas", "Electricity", "Fuel Oil", "None", "Propane")
COOLING = ("AC", "Room AC", "None", "AC")


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in values) + ")"


def simulated(spark, folder) -> DataFrame:
    """Actual and predicted energy per building, scenario and fuel, with attributes."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 100).alias("units"),
        (
            F.round(F.col("l_extendedprice") * 100).cast("long")
            * (100 - F.round(F.col("l_discount") * 100).cast("long"))
        ).alias("units_pred"),
    )
    sums = lines.groupBy("l_orderkey", "l_linenumber").agg(
        *[
            F.sum(F.when(F.col("l_returnflag") == flag, F.col(source))).alias(f"{fuel}{suffix}")
            for fuel, flag in FUEL_FLAGS.items()
            for source, suffix in (("units", ""), ("units_pred", "-pred"))
        ],
        F.sum("units").alias("electricity"),
        F.sum("units_pred").alias("electricity-pred"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    later = F.col("l_orderkey") % 3 == 0
    position = "cast(l_linenumber as int)"
    energy = [
        (
            F.coalesce(F.col(f) / 10000, F.lit(0.0)).alias(f),
            (F.col(f"`{f}-pred`") / 10000).alias(f"{f}-pred"),
        )
        for f in FUELS
    ]
    heat_pump = (F.col("l_linenumber") >= 3) & (F.col("o_custkey") % 2 == 0)
    return sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("building_id"),
        F.when(later, F.expr(f"element_at({_array(IDS_2024)}, {position})"))
        .otherwise(F.expr(f"element_at({_array(IDS_2022)}, {position})"))
        .alias("upgrade_id"),
        F.when(later, "ResStock 2024.2").otherwise("ResStock 2022.1").alias("building_set"),
        *[c for pair in energy for c in pair],
        F.expr(f"element_at({_array(HEATING)}, cast(o_custkey % 5 as int) + 1)").alias(
            "heating_fuel"
        ),
        F.when(heat_pump, "Heat Pump")
        .otherwise(F.expr(f"element_at({_array(COOLING)}, cast(o_custkey % 4 as int) + 1)"))
        .alias("ac_type"),
        F.when(F.col("o_orderstatus") == "O", "Natural Gas")
        .when(F.col("o_orderstatus") == "F", "Electricity")
        .otherwise("Propane")
        .alias("water_heater_fuel"),
    )


def errors(spark, folder) -> DataFrame:
    """Errors of every fuel."""
    return evaluation.errors_by_fuel(evaluation.with_baselines(simulated(spark, folder), FUELS), FUELS)


def settled_errors(spark, folder) -> DataFrame:
    """The same for reports, which pass over the rows more than once."""
    based = settle(evaluation.with_baselines(simulated(spark, folder), FUELS), "based")
    return evaluation.errors_by_fuel(based, FUELS)


SIMULATED = """
WITH line AS (SELECT *, round(l_extendedprice * 100)::BIGINT * 100 AS units,
    round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) AS units_pred FROM lineitem),
sums AS (SELECT l_orderkey, l_linenumber, sum(units) AS e, sum(units_pred) AS ep,
    sum(units) FILTER (l_returnflag = 'A') AS g, sum(units_pred) FILTER (l_returnflag = 'A') AS gp,
    sum(units) FILTER (l_returnflag = 'R') AS o, sum(units_pred) FILTER (l_returnflag = 'R') AS op,
    sum(units) FILTER (l_returnflag = 'N') AS p, sum(units_pred) FILTER (l_returnflag = 'N') AS pp
  FROM line GROUP BY ALL),
sim AS (SELECT l_orderkey AS building_id,
    CASE WHEN l_orderkey % 3 = 0 THEN list_extract([0.01, 11.07, 13.02, 15.04, 15.05, 15.06, 15.08], l_linenumber)
      ELSE list_extract([0.0, 1.0, 3.0, 4.0, 6.0, 9.0, 11.05], l_linenumber) END::DOUBLE AS upgrade_id,
    CASE WHEN l_orderkey % 3 = 0 THEN 'ResStock 2024.2' ELSE 'ResStock 2022.1' END AS building_set,
    e::DOUBLE / 10000 AS electricity, ep::DOUBLE / 10000 AS electricity_pred,
    coalesce(g::DOUBLE / 10000, 0) AS natural_gas, gp::DOUBLE / 10000 AS natural_gas_pred,
    coalesce(o::DOUBLE / 10000, 0) AS fuel_oil, op::DOUBLE / 10000 AS fuel_oil_pred,
    coalesce(p::DOUBLE / 10000, 0) AS propane, pp::DOUBLE / 10000 AS propane_pred,
    list_extract(['Natural Gas', 'Electricity', 'Fuel Oil', 'None', 'Propane'], (o_custkey % 5)::INTEGER + 1) AS raw_fuel,
    CASE WHEN l_linenumber >= 3 AND o_custkey % 2 = 0 THEN 'Heat Pump'
      ELSE list_extract(['AC', 'Room AC', 'None', 'AC'], (o_custkey % 4)::INTEGER + 1) END AS raw_ac,
    CASE o_orderstatus WHEN 'O' THEN 'Natural Gas' WHEN 'F' THEN 'Electricity' ELSE 'Propane' END AS water_heater_fuel
  FROM sums JOIN orders ON o_orderkey = l_orderkey),
named AS (SELECT *, CASE WHEN raw_ac = 'Heat Pump' THEN 'Heat Pump' WHEN raw_fuel = 'Electricity' THEN 'Electric Resistance'
      WHEN raw_fuel = 'None' THEN 'No Heating' ELSE raw_fuel END AS heating_fuel,
    CASE WHEN raw_ac = 'None' THEN 'No Cooling' ELSE raw_ac END AS ac_type FROM sim),
long AS (
  SELECT building_id, upgrade_id, building_set, heating_fuel, ac_type, water_heater_fuel,
    'electricity' AS fuel, electricity AS actual, electricity_pred AS prediction FROM named
  UNION ALL SELECT building_id, upgrade_id, building_set, heating_fuel, ac_type, water_heater_fuel,
    'natural_gas', natural_gas, natural_gas_pred FROM named
  UNION ALL SELECT building_id, upgrade_id, building_set, heating_fuel, ac_type, water_heater_fuel,
    'fuel_oil', fuel_oil, fuel_oil_pred FROM named
  UNION ALL SELECT building_id, upgrade_id, building_set, heating_fuel, ac_type, water_heater_fuel,
    'propane', propane, propane_pred FROM named
  UNION ALL SELECT building_id, upgrade_id, building_set, heating_fuel, ac_type, water_heater_fuel,
    'total', electricity + natural_gas + fuel_oil + propane,
    coalesce(electricity_pred, 0) + coalesce(natural_gas_pred, 0) + coalesce(fuel_oil_pred, 0) + coalesce(propane_pred, 0) FROM named),
based AS (SELECT *, first_value(actual) OVER w AS actual_baseline, first_value(prediction) OVER w AS prediction_baseline,
    CASE WHEN upgrade_id = 6 THEN first_value(water_heater_fuel) OVER w ELSE first_value(heating_fuel) OVER w END AS baseline_appliance,
    first_value(ac_type) OVER w AS baseline_ac_type
  FROM long WINDOW w AS (PARTITION BY building_id, building_set, fuel ORDER BY upgrade_id)),
saved AS (SELECT *, actual_baseline - actual AS actual_savings, prediction_baseline - prediction AS prediction_savings,
    abs(prediction - actual) AS absolute_error FROM based),
erred AS (SELECT *, CASE WHEN upgrade_id <> 0 THEN abs(prediction_savings - actual_savings) END AS absolute_error_savings FROM saved),
errors AS (SELECT *,
    CASE WHEN abs(actual) >= 1e-3 THEN abs(absolute_error / actual) * 100 END AS absolute_percentage_error,
    CASE WHEN abs(actual_savings) >= 1e-3 THEN abs(absolute_error_savings / actual_savings) * 100 END AS absolute_percentage_error_savings
  FROM erred)
"""

METRICS = """
  round(median(absolute_error), 0) AS median_absolute_error,
  round(median(absolute_percentage_error), 1) AS median_absolute_percentage_error,
  round(median(absolute_error_savings), 0) AS median_absolute_error_savings,
  round(median(absolute_percentage_error_savings), 1) AS median_absolute_percentage_error_savings,
  round(avg(absolute_error), 0) AS mean_absolute_error,
  round(avg(absolute_percentage_error), 1) AS mean_absolute_percentage_error,
  round(avg(absolute_error_savings), 0) AS mean_absolute_error_savings,
  round(avg(absolute_percentage_error_savings), 1) AS mean_absolute_percentage_error_savings,
  round(100 * sum(absolute_error) / sum(abs(actual)), 1) AS weighted_mean_absolute_percentage_error,
  CASE WHEN sum(abs(actual_savings)) <> 0 THEN round(100 * sum(absolute_error_savings) / sum(abs(actual_savings)), 1) END
    AS weighted_mean_absolute_percentage_error_savings
"""


def report_sql(by: str = "") -> str:
    extra = f", {by}" if by else ""
    return f"""
SELECT baseline_appliance AS type, upgrade_id::VARCHAR AS upgrade_id{extra}, {METRICS} FROM errors
  WHERE fuel = 'total' GROUP BY baseline_appliance, upgrade_id{extra}
UNION ALL SELECT 'Total', upgrade_id::VARCHAR{extra}, {METRICS} FROM errors WHERE fuel = 'total' GROUP BY upgrade_id{extra}
UNION ALL SELECT baseline_ac_type, upgrade_id::VARCHAR{extra}, {METRICS} FROM errors
  WHERE fuel = 'total' AND upgrade_id = 0 AND baseline_ac_type <> 'Heat Pump' GROUP BY baseline_ac_type, upgrade_id{extra}
UNION ALL SELECT CASE fuel WHEN 'natural_gas' THEN 'Natural Gas' WHEN 'fuel_oil' THEN 'Fuel Oil'
    WHEN 'propane' THEN 'Propane' ELSE 'Electricity' END, 'Total By Fuel'{extra}, {METRICS} FROM errors
  WHERE fuel <> 'total' AND prediction IS NOT NULL GROUP BY fuel{extra}
"""


@registry.add(SIMULATED + report_sql())
def metric_report(spark, folder):
    return evaluation.metric_report(settled_errors(spark, folder))


@registry.add(
    SIMULATED + ", report AS (" + report_sql() + ") "
    'SELECT upgrade_id AS "Upgrade ID", type AS "Type", median_absolute_error AS "Median Abs Error", '
    'weighted_mean_absolute_percentage_error AS "Weighted Mean APE", '
    "row_number() OVER (ORDER BY upgrade_id, coalesce(list_position(['Electricity', 'Electric Resistance', "
    "'Natural Gas', 'Propane', 'Fuel Oil', 'No Heating', 'None', 'Heat Pump', 'AC', 'Room AC', 'No Cooling', "
    "'Total'], type), 99)) - 1 AS position FROM report"
)
def report_order(spark, folder):
    report = evaluation.metric_report(settled_errors(spark, folder))
    ordered = evaluation.ordered_report(report).coalesce(1)
    return ordered.select(
        "Upgrade ID",
        "Type",
        "Median Abs Error",
        "Weighted Mean APE",
        F.monotonically_increasing_id().alias("position"),
    )


@registry.add(
    SIMULATED + "SELECT building_id, fuel, count(*) AS n_scenarios, count(prediction_savings) AS n_predicted, "
    "sum(round(actual_savings * 10000)::BIGINT)::BIGINT AS actual_savings, "
    "coalesce(sum(round(prediction_savings * 10000)::BIGINT), 0)::BIGINT AS prediction_savings "
    "FROM errors GROUP BY building_id, fuel"
)
def baseline_savings(spark, folder):
    def units(c: str):
        return F.coalesce(F.sum(F.round(F.col(c) * 10000).cast("long")), F.lit(0)).alias(c)

    return errors(spark, folder).groupBy("building_id", "fuel").agg(
        F.count(F.lit(1)).alias("n_scenarios"),
        F.count("prediction_savings").alias("n_predicted"),
        units("actual_savings"),
        units("prediction_savings"),
    )


@registry.add(
    SIMULATED + "SELECT upgrade_id, baseline_appliance, baseline_ac_type, count(*) AS n_buildings "
    "FROM errors WHERE fuel = 'total' GROUP BY ALL"
)
def baseline_attributes(spark, folder):
    rows = errors(spark, folder).where("fuel = 'total'")
    return rows.groupBy("upgrade_id", "baseline_appliance", "baseline_ac_type").agg(
        F.count(F.lit(1)).alias("n_buildings")
    )


@registry.add(
    SIMULATED + "SELECT upgrade_id, fuel, count(*) AS n_rows, count(prediction) AS n_predicted, "
    "sum(round(actual * 10000)::BIGINT)::BIGINT AS actual, sum(round(prediction * 10000)::BIGINT)::BIGINT AS prediction "
    "FROM long WHERE fuel <> 'total' GROUP BY ALL"
)
def unpivot_pivot_long(spark, folder):
    ids = list(evaluation.KEYS)
    # Every row becomes as many groups as there are fuels, none of which fold.
    wide = dealt(simulated(spark, folder), table(spark, folder, "lineitem").count(), "building_id")
    long = evaluation.unpivot_pairs(wide, ids, FUELS)
    pairs = evaluation.pivot_fixed(long, [*ids, "fuel"], "target_type", ["actual", "prediction"])
    return pairs.groupBy("upgrade_id", "fuel").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("prediction").alias("n_predicted"),
        *[
            F.sum(F.round(F.col(c) * 10000).cast("long")).alias(c)
            for c in ("actual", "prediction")
        ],
    )


PRICES = (
    "round(l_extendedprice * 100)::BIGINT * 100 AS actual, "
    "round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) AS prediction"
)


def priced_lines(spark, folder) -> DataFrame:
    """Line items with an actual and a predicted amount in hundredths of a cent."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    off = F.round(F.col("l_discount") * 100).cast("long")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_returnflag",
        "l_linestatus",
        (cents * 100).alias("actual"),
        (cents * (100 - off)).alias("prediction"),
        off.alias("percent_off"),
    )


@registry.add(
    f"WITH v AS (SELECT *, {PRICES} FROM lineitem) SELECT l_returnflag, l_linestatus, "
    "round(sum(abs(prediction - actual)) / sum(abs(actual))::DOUBLE, 8) AS wmape, "
    "round((avg(prediction - actual)) / avg(actual), 8) AS wmpe, count(*) AS n_rows FROM v GROUP BY ALL"
)
def wmape_by_group(spark, folder):
    error = F.col("prediction") - F.col("actual")
    return priced_lines(spark, folder).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(metrics.weighted_error(F.abs(error), "actual"), 8).alias("wmape"),
        F.round(metrics.ratio_of_means(error, F.col("actual")), 8).alias("wmpe"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@registry.add(
    "WITH v AS (SELECT l_linenumber, l_returnflag, round(l_discount * 100)::DOUBLE AS a, l_quantity AS q FROM lineitem) "
    "SELECT l_linenumber, l_returnflag, round(coalesce(avg(abs(a - q)) FILTER (a <> 0), 0), 6) AS mae, "
    "round(100 * avg(abs((a - q) / a)) FILTER (a <> 0), 6) AS mape FROM v GROUP BY ALL"
)
def masked_mae(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_linenumber",
        "l_returnflag",
        F.round(F.col("l_discount") * 100).alias("a"),
        F.col("l_quantity").alias("q"),
    )
    return rows.groupBy("l_linenumber", "l_returnflag").agg(
        F.round(metrics.masked_mae("a", "q"), 6).alias("mae"),
        F.round(metrics.nonzero_mape("a", "q"), 6).alias("mape"),
    )


@registry.add(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "coalesce(round(CASE WHEN abs(l_discount) >= 1e-3 THEN abs((l_tax - l_discount) / l_discount) * 100 END, 4), -1) AS ape "
    "FROM lineitem"
)
def ape_nulling(spark, folder):
    error = F.col("l_tax") - F.col("l_discount")
    ape = metrics.absolute_percentage_error(error, "l_discount")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.coalesce(F.round(ape, 4), F.lit(-1.0)).alias("ape"),
    )


@registry.add(
    SIMULATED + f"SELECT building_set AS grouping, 'All' AS type, {METRICS} FROM errors GROUP BY building_set "
    f"UNION ALL SELECT upgrade_id::VARCHAR, 'Scenario', {METRICS} FROM errors GROUP BY upgrade_id"
)
def grouped_metric_union(spark, folder):
    rows = settled_errors(spark, folder)
    by_set = evaluation.aggregate_metrics(rows, ["building_set"]).withColumn("type", F.lit("All"))
    by_scenario = evaluation.aggregate_metrics(rows, ["upgrade_id"]).withColumns(
        {"type": F.lit("Scenario"), "upgrade_id": F.col("upgrade_id").cast("string")}
    )
    return by_set.withColumnRenamed("building_set", "grouping").unionByName(
        by_scenario.withColumnRenamed("upgrade_id", "grouping")
    )


ORDER_SQL = """
WITH line AS (SELECT l_orderkey, l_linenumber, sum(round(l_extendedprice * 100)::BIGINT * 100)::DOUBLE AS a,
    sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) * (1 + l_linenumber % 3))::DOUBLE AS p
  FROM lineitem GROUP BY ALL),
pair AS (SELECT x.l_linenumber AS u1, y.l_linenumber AS u2, (x.a - y.a) * (x.p - y.p) < 0 AS wrong
  FROM line x JOIN line y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber),
ends AS (SELECT u1 AS scenario, wrong FROM pair UNION ALL SELECT u2, wrong FROM pair)
"""


def _ordered_lines(spark, folder) -> DataFrame:
    factor = 1 + F.col("l_linenumber") % 3
    priced = priced_lines(spark, folder)
    lines = priced.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("actual").cast("double").alias("actual"),
        F.sum(F.col("prediction") * factor).cast("double").alias("prediction"),
    )
    # An order has few rows now; the buffers of its scenarios side by side are wide.
    return dealt(lines, priced.count(), "l_orderkey")


@registry.add(
    ORDER_SQL + "SELECT scenario, round(count(*) FILTER (wrong) / count(*), 8) AS error_rate, "
    "count(*) AS occurrences FROM ends GROUP BY scenario"
)
def ordering_error(spark, folder):
    found = comparison.ordering_errors(
        _ordered_lines(spark, folder), ["l_orderkey"], "l_linenumber", range(1, 8)
    )
    rates = comparison.ordering_error_rates(found, "l_linenumber")
    return rates.select(
        F.col("l_linenumber").alias("scenario"),
        F.round("error_rate", 8).alias("error_rate"),
        "occurrences",
    )


@registry.add(
    ORDER_SQL + "SELECT round(count(*) FILTER (wrong) / count(*), 8) AS error_rate, count(*) AS n_pairs FROM pair"
)
def ordering_error_global(spark, folder):
    found = comparison.ordering_errors(
        _ordered_lines(spark, folder), ["l_orderkey"], "l_linenumber", range(1, 8)
    )
    return comparison.global_ordering_error(found).withColumn(
        "error_rate", F.round("error_rate", 8)
    )


@registry.add(
    ORDER_SQL + "SELECT x.l_linenumber AS scenario, y.l_linenumber AS predicted_scenario, count(*) AS n_rows, "
    "round(regr_slope(y.p / 1e6, x.a / 1e6), 6) AS slope, round(regr_intercept(y.p / 1e6, x.a / 1e6), 5) AS intercept "
    "FROM line x JOIN line y ON x.l_orderkey = y.l_orderkey GROUP BY ALL"
)
def cross_scenario_trends(spark, folder):
    rows = _ordered_lines(spark, folder).withColumns(
        {"actual": F.col("actual") / 1e6, "prediction": F.col("prediction") / 1e6}
    )
    trends = comparison.cross_scenario_trends(
        settle(rows, "ordered-lines"), ["l_orderkey"], "l_linenumber", range(1, 8)
    )
    return trends.select(
        F.col("l_linenumber").alias("scenario"),
        "predicted_scenario",
        "n_rows",
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 5).alias("intercept"),
    )


@registry.add(
    "WITH y AS (SELECT *, round(o_totalprice * 100)::BIGINT AS cents, o_orderdate >= DATE '1995-06-01' AS later FROM orders), "
    "v AS (SELECT o_custkey, o_orderstatus, later, count(*) AS n, sum(cents)::BIGINT AS cents FROM y GROUP BY ALL) "
    "SELECT o_custkey, o_orderstatus, coalesce(b.n - a.n, 0) AS n, coalesce(b.cents - a.cents, 0) AS cents "
    "FROM (FROM v WHERE NOT later) a FULL JOIN (FROM v WHERE later) b USING (o_custkey, o_orderstatus)"
)
def version_diff(spark, folder):
    """Earlier and later orders by customer and status; many have only one of them."""
    keys = ["o_custkey", "o_orderstatus"]
    orders = table(spark, folder, "orders").withColumn(
        "later", F.col("o_orderdate") >= F.lit("1995-06-01").cast("date")
    )

    def version(kept: str) -> DataFrame:
        return orders.where(kept).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        )

    return comparison.table_difference(version("not later"), version("later"), keys).fillna(
        0, subset=["n", "cents"]
    )


@registry.add(
    SIMULATED + ", stacked AS (SELECT *, 'first' AS version FROM errors UNION ALL "
    "SELECT * REPLACE (absolute_error * 2 AS absolute_error), 'second' FROM errors), "
    "names(upgrade_id, upgrade_name) AS (VALUES (0.0::DOUBLE, 'Baseline'), (0.01, 'Baseline, no setback'), (1.0, 'Basic enclosure'), "
    "(3.0, 'Minimum-efficiency heat pump'), (4.0, 'High-efficiency heat pump'), (6.0, 'Heat pump water heater'), "
    "(9.0, 'Whole-home electrification and basic enclosure'), (11.05, 'Medium-efficiency heat pump, no setback'), "
    "(11.07, 'Medium-efficiency heat pump, no setback, later stock'), "
    "(13.02, 'Medium-efficiency heat pump, no setback, light air sealing'), "
    "(15.04, 'Cold-climate ductless heat pump, first product'), (15.05, 'Cold-climate ductless heat pump, second product'), "
    "(15.06, 'Cold-climate ductless heat pump, third product'), (15.08, 'Cold-climate ducted heat pump')) "
    "SELECT version, upgrade_name || ' (' || upgrade_id::VARCHAR || ')' AS upgrade_name, "
    "CASE baseline_appliance WHEN 'Electric Resistance' THEN 'Electricity' ELSE baseline_appliance END AS baseline_fuel, "
    "count(*) AS n_rows, sum(round(CASE WHEN upgrade_id IN (0, 0.01) THEN absolute_error ELSE absolute_error_savings END * 10000)::BIGINT)::BIGINT AS error "
    "FROM stacked JOIN names USING (upgrade_id) WHERE fuel = 'total' "
    "AND baseline_appliance NOT IN ('Heat Pump', 'No Heating') GROUP BY ALL"
)
def version_stack(spark, folder):
    first = errors(spark, folder)
    second = first.withColumn("absolute_error", F.col("absolute_error") * 2)
    stacked = comparison.stack_versions({"first": first, "second": second})
    names = catalogue(spark).select("upgrade_id", "upgrade_name")
    rows = comparison.comparable_errors(stacked, names)
    return rows.groupBy("version", "upgrade_name", "baseline_fuel").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.round(F.col("absolute_error") * 10000).cast("long")).alias("error"),
    )


@registry.add(
    "WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi "
    "FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, count(*) AS n_kept, "
    "sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest "
    "FROM lineitem JOIN b USING (l_returnflag) WHERE l_extendedprice BETWEEN lo AND hi GROUP BY l_returnflag"
)
def percentile_band(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    kept = band(lines, ["l_returnflag"], "l_extendedprice")
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.min("l_extendedprice").alias("lowest"),
        F.max("l_extendedprice").alias("highest"),
    )


@registry.add(
    "WITH b AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi "
    "FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, count(*) AS n_kept, sum(l_quantity)::BIGINT AS quantity "
    "FROM lineitem JOIN b USING (l_returnflag, l_linestatus) WHERE l_quantity > lo AND l_quantity < hi GROUP BY ALL"
)
def percentile_band_strict(spark, folder):
    keys = ["l_returnflag", "l_linestatus"]
    lines = table(spark, folder, "lineitem").select(*keys, "l_quantity")
    kept = band(lines, keys, "l_quantity", strict=True)
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_kept"), F.sum("l_quantity").cast("long").alias("quantity")
    )


@registry.add(
    f"WITH v AS (SELECT l_linenumber, prediction - actual AS error, (actual - prediction) * 2 AS savings_error "
    f"FROM (SELECT *, {PRICES} FROM lineitem)) SELECT l_linenumber, median(error) AS median_error, "
    "median(savings_error) AS median_savings_error, round(avg(error), 2) AS mean_error, "
    "round(avg(savings_error), 2) AS mean_savings_error, count(error) AS count_error, "
    "count(savings_error) AS count_savings_error FROM v GROUP BY l_linenumber"
)
def error_summary(spark, folder):
    rows = priced_lines(spark, folder).select(
        "l_linenumber",
        (F.col("prediction") - F.col("actual")).alias("error"),
        ((F.col("actual") - F.col("prediction")) * 2).alias("savings_error"),
    )
    found = evaluation.error_summary(rows, ["l_linenumber"], ["error", "savings_error"])
    return found.withColumns(
        {c: F.round(c, 2) for c in ("mean_error", "mean_savings_error")}
    )


@registry.add(
    "SELECT l_linenumber, median(l_quantity) AS median_l_quantity, round(avg(l_quantity), 6) AS mean_l_quantity, "
    "round(stddev(l_quantity), 6) AS std_l_quantity, min(l_quantity) AS min_l_quantity, "
    "max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY l_linenumber"
)
def value_spread(spark, folder):
    found = evaluation.value_spread(
        table(spark, folder, "lineitem"), ["l_linenumber"], "l_quantity"
    )
    return found.withColumns(
        {c: F.round(c, 6) for c in ("mean_l_quantity", "std_l_quantity")}
    )


@registry.add(
    f"WITH v AS (SELECT *, {PRICES} FROM lineitem), e AS (SELECT "
    "CASE l_returnflag WHEN 'A' THEN 'heating' WHEN 'R' THEN 'cooling' ELSE 'hvac' END AS end_use, l_linestatus AS type, "
    "abs(prediction - actual) AS err, abs(prediction - actual) / actual * 100 AS ape FROM v) "
    "SELECT end_use, type, round(median(err), 2) AS median_abs_error, round(median(ape), 4) AS median_ape, "
    "round(avg(err), 2) AS mean_abs_error, round(avg(ape), 4) AS mape FROM e WHERE end_use <> 'hvac' GROUP BY end_use, type "
    "UNION ALL SELECT end_use, 'Total', round(median(err), 2), round(median(ape), 4), round(avg(err), 2), round(avg(ape), 4) "
    "FROM e GROUP BY end_use"
)
def end_use_report(spark, folder):
    rows = priced_lines(spark, folder).select(
        F.when(F.col("l_returnflag") == "A", "heating")
        .when(F.col("l_returnflag") == "R", "cooling")
        .otherwise("hvac")
        .alias("end_use"),
        F.col("l_linestatus").alias("type"),
        "actual",
        "prediction",
    )
    return evaluation.end_use_report(rows).select(
        "end_use",
        "type",
        F.round("median_abs_error", 2).alias("median_abs_error"),
        F.round("median_ape", 4).alias("median_ape"),
        F.round("mean_abs_error", 2).alias("mean_abs_error"),
        F.round("mape", 4).alias("mape"),
    )


BUCKET_SQL = f"""
WITH v AS (SELECT *, {PRICES} FROM lineitem),
bucket AS (SELECT p_partkey AS id, round(p_retailprice * 100)::BIGINT AS median_cents,
    CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'dryer' WHEN p_type = 'MEDIUM' THEN 'range' ELSE 'hvac' END AS end_use FROM part),
base AS (SELECT l_orderkey AS building_id, 0.0::DOUBLE AS upgrade_id, end_use, actual AS kwh_upgrade,
    median_cents AS kwh_upgrade_median, NULL::BIGINT AS kwh_delta_median
  FROM v JOIN bucket ON id = l_partkey WHERE l_linenumber = 1),
ups AS (SELECT l_orderkey, l_linenumber::DOUBLE + 5, end_use, NULL::BIGINT, median_cents, median_cents * 2
  FROM v JOIN bucket ON id = l_partkey WHERE l_linenumber > 1),
both_sides AS (SELECT * FROM base UNION ALL SELECT * FROM ups),
summed AS (SELECT building_id, CASE WHEN upgrade_id = 8 AND end_use = 'dryer' THEN 8.1
    WHEN upgrade_id = 8 AND end_use = 'range' THEN 8.2 ELSE upgrade_id END::DOUBLE AS upgrade_id,
    sum(kwh_upgrade_median)::BIGINT AS kwh_upgrade_median, sum(kwh_delta_median)::BIGINT AS kwh_delta_median,
    abs(sum(kwh_upgrade) - sum(kwh_upgrade_median))::BIGINT AS absolute_error FROM both_sides GROUP BY ALL)
"""


def _buckets(spark, folder) -> DataFrame:
    """Benchmark predictions per building and scenario, from the parts of an order."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("kwh_upgrade_median"),
        F.when(F.col("p_type").isin("SMALL", "LARGE"), "dryer")
        .when(F.col("p_type") == "MEDIUM", "range")
        .otherwise("hvac")
        .alias("end_use"),
    )
    lines = priced_lines(spark, folder)
    ids = [F.col("l_orderkey").alias("building_id"), F.col("l_partkey").alias("bucket_id")]
    baseline = bucket_predictions(
        lines.where("l_linenumber = 1").select(
            *ids, F.lit(0.0).alias("upgrade_id"), F.col("actual").alias("kwh_upgrade")
        ),
        parts,
    )
    upgrades = bucket_predictions(
        lines.where("l_linenumber > 1").select(
            *ids, (F.col("l_linenumber") + 5.0).alias("upgrade_id")
        ),
        parts.withColumn("kwh_delta_median", F.col("kwh_upgrade_median") * 2),
    )
    measures = ["kwh_upgrade_median", "kwh_delta_median", "kwh_upgrade"]
    summed = split_bucket_benchmark(baseline, upgrades, measures)
    error = F.abs(F.col("kwh_upgrade") - F.col("kwh_upgrade_median"))
    return summed.withColumn("absolute_error", error).drop("kwh_upgrade")


@registry.add(
    BUCKET_SQL + "SELECT upgrade_id, count(*) AS n_rows, sum(kwh_upgrade_median)::BIGINT AS predicted, "
    "coalesce(sum(kwh_delta_median), 0)::BIGINT AS saved, coalesce(sum(absolute_error), 0)::BIGINT AS error "
    "FROM summed GROUP BY upgrade_id"
)
def bucket_benchmark(spark, folder):
    return _buckets(spark, folder).groupBy("upgrade_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("kwh_upgrade_median").alias("predicted"),
        F.coalesce(F.sum("kwh_delta_median"), F.lit(0)).alias("saved"),
        F.coalesce(F.sum("absolute_error"), F.lit(0)).alias("error"),
    )


MODEL_SQL = (
    SIMULATED
    + BUCKET_SQL.replace("WITH v AS", ", v AS")
    + """
, paired AS (SELECT e.building_id, e.upgrade_id, e.building_set, e.fuel, e.actual, e.actual_savings,
    e.baseline_appliance, e.baseline_ac_type, e.prediction, e.prediction_savings,
    s.kwh_upgrade_median::DOUBLE AS bp, s.kwh_delta_median::DOUBLE AS bs, s.absolute_error::DOUBLE AS be
  FROM errors e LEFT JOIN summed s ON e.building_id = s.building_id AND e.upgrade_id = s.upgrade_id AND e.fuel = 'total'),
models AS (
  SELECT * EXCLUDE (bp, bs, be), 'Surrogate' AS model, abs(prediction - actual) AS absolute_error FROM paired
  UNION ALL SELECT * EXCLUDE (bp, bs, be) REPLACE (bp AS prediction, bs AS prediction_savings), 'Bucketed',
    CASE WHEN upgrade_id = 0 THEN be END FROM paired),
modelled AS (SELECT *, CASE WHEN upgrade_id <> 0 THEN abs(prediction_savings - actual_savings) END AS absolute_error_savings FROM models),
compared AS (SELECT *,
    CASE WHEN abs(actual) >= 1e-3 THEN abs(absolute_error / actual) * 100 END AS absolute_percentage_error,
    CASE WHEN abs(actual_savings) >= 1e-3 THEN abs(absolute_error_savings / actual_savings) * 100 END AS absolute_percentage_error_savings
  FROM modelled)
"""
)


def _models(spark, folder) -> DataFrame:
    benchmark = _buckets(spark, folder)
    doubles = [c for c in benchmark.columns if c not in ("building_id", "upgrade_id")]
    benchmark = benchmark.withColumns({c: F.col(c).cast("double") for c in doubles})
    based = evaluation.with_baselines(simulated(spark, folder), FUELS)
    return evaluation.with_benchmark(based, benchmark)


@registry.add(
    MODEL_SQL + "SELECT model, upgrade_id, count(*) AS n_rows, count(prediction) AS n_predictions, "
    "round(coalesce(avg(absolute_error), -1), 2) AS mean_error, "
    "round(coalesce(avg(absolute_percentage_error_savings), -1), 3) AS mean_ape_savings "
    "FROM compared WHERE fuel = 'total' GROUP BY model, upgrade_id"
)
def model_long_compare(spark, folder):
    rows = evaluation.model_errors(_models(spark, folder), FUELS).where("fuel = 'total'")
    return rows.groupBy("model", "upgrade_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("prediction").alias("n_predictions"),
        F.round(F.coalesce(F.avg("absolute_error"), F.lit(-1.0)), 2).alias("mean_error"),
        F.round(
            F.coalesce(F.avg("absolute_percentage_error_savings"), F.lit(-1.0)), 3
        ).alias("mean_ape_savings"),
    )


@registry.add(
    MODEL_SQL + ", report AS (" + report_sql("model").replace("FROM errors", "FROM compared") + ") "
    "SELECT type, upgrade_id, "
    "coalesce(max(median_absolute_error) FILTER (model = 'Surrogate'), -1) AS surrogate, "
    "coalesce(max(median_absolute_error) FILTER (model = 'Bucketed'), -1) AS bucketed, "
    "coalesce(max(mean_absolute_error_savings) FILTER (model = 'Bucketed'), -1) AS bucketed_savings "
    "FROM report GROUP BY type, upgrade_id"
)
def report_by_model(spark, folder):
    rows = evaluation.model_errors(settle(_models(spark, folder), "models"), FUELS)
    report = evaluation.metric_report(rows, by=["model"])
    wide = evaluation.report_by_model(report, ["Surrogate", "Bucketed"])
    return wide.select(
        "type",
        "upgrade_id",
        F.coalesce("median_absolute_error|Surrogate", F.lit(-1.0)).alias("surrogate"),
        F.coalesce("median_absolute_error|Bucketed", F.lit(-1.0)).alias("bucketed"),
        F.coalesce("mean_absolute_error_savings|Bucketed", F.lit(-1.0)).alias("bucketed_savings"),
    )


@registry.add(
    f"WITH v AS (SELECT *, {PRICES} FROM lineitem) SELECT l_orderkey, sum(actual - prediction)::BIGINT AS kwh_delta, "
    "sum(round(l_discount * 100)::BIGINT)::BIGINT AS cost_delta FROM v GROUP BY l_orderkey"
)
def savings_by_building(spark, folder):
    rows = priced_lines(spark, folder).select(
        "l_orderkey",
        (F.col("actual") - F.col("prediction")).alias("kwh_delta"),
        F.col("percent_off").alias("cost_delta"),
    )
    return evaluation.savings_by_building(rows, ["l_orderkey"], ["kwh_delta", "cost_delta"])
