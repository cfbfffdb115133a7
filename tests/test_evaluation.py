from __future__ import annotations

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hearthgrid.operators import comparison, evaluation
from tests.conftest import values

FUELS = ("electricity", "natural_gas")
WIDE = (
    "building_id int, upgrade_id double, building_set string, electricity double, `electricity-pred` double, "
    "natural_gas double, `natural_gas-pred` double, heating_fuel string, ac_type string, water_heater_fuel string"
)


def wide(spark):
    rows = [
        (1, 0.0, "A", 100.0, 110.0, 50.0, 40.0, "Natural Gas", "AC", "Propane"),
        (1, 6.0, "A", 90.0, 90.0, 50.0, 40.0, "Electricity", "Heat Pump", "Electricity"),
        (1, 1.0, "A", 80.0, 85.0, 0.0, 0.0, "Electricity", "Heat Pump", "Electricity"),
        (2, 0.01, "B", 200.0, 190.0, 0.0, None, "Electricity", "None", "Electricity"),
        (2, 3.0, "B", 200.0, 150.0, 0.0, None, "Electricity", "Heat Pump", "Electricity"),
    ]
    return spark.createDataFrame(rows, WIDE)


def errors(spark):
    return evaluation.errors_by_fuel(evaluation.with_baselines(wide(spark), FUELS), FUELS)


def one(df, building, scenario, fuel):
    return df.where(
        (F.col("building_id") == building) & (F.col("upgrade_id") == scenario) & (F.col("fuel") == fuel)
    ).first()


def test_errors(spark):
    df = errors(spark)
    assert df.count() == 15
    row = one(df, 1, 1.0, "total")
    assert (row["actual"], row["prediction"]) == (80.0, 85.0)
    assert (row["actual_savings"], row["prediction_savings"]) == (70.0, 65.0)
    assert (row["absolute_error"], row["absolute_error_savings"]) == (5.0, 5.0)
    assert row["absolute_percentage_error"] == pytest.approx(6.25)
    assert row["baseline_appliance"] == "Natural Gas" and row["baseline_ac_type"] == "AC"


def test_baselines(spark):
    df = errors(spark)
    first = one(df, 1, 0.0, "total")
    assert first["absolute_error_savings"] is None and first["actual_savings"] == 0.0
    second = one(df, 2, 0.01, "total")
    assert second["absolute_error_savings"] == 0.0
    assert second["absolute_percentage_error_savings"] is None
    assert one(df, 1, 6.0, "total")["baseline_appliance"] == "Propane"
    assert (second["baseline_appliance"], second["baseline_ac_type"]) == (
        "Electric Resistance",
        "No Cooling",
    )


def test_fuel_a_home_lacks(spark):
    row = one(errors(spark), 2, 3.0, "natural_gas")
    assert row["prediction"] is None and row["absolute_error"] is None
    assert row["absolute_percentage_error"] is None
    assert one(errors(spark), 2, 3.0, "total")["prediction"] == 150.0


def test_report_lines(spark):
    report = evaluation.metric_report(errors(spark))
    lines = {(r["type"], r["upgrade_id"]): r for r in report.collect()}
    assert set(lines) == {
        ("Natural Gas", "0.0"), ("Natural Gas", "1.0"), ("Propane", "6.0"), ("AC", "0.0"),
        ("Electric Resistance", "0.01"), ("Electric Resistance", "3.0"),
        ("Total", "0.0"), ("Total", "0.01"), ("Total", "1.0"), ("Total", "3.0"), ("Total", "6.0"),
        ("Electricity", "Total By Fuel"), ("Natural Gas", "Total By Fuel"),
    }
    by_fuel = lines[("Electricity", "Total By Fuel")]
    assert by_fuel["median_absolute_error"] == statistics.median([10, 0, 5, 10, 50])
    assert by_fuel["weighted_mean_absolute_percentage_error"] == pytest.approx(
        round(100 * 75 / 670, 1)
    )
    assert lines[("Total", "0.0")]["median_absolute_error_savings"] is None
    gas = lines[("Natural Gas", "Total By Fuel")]
    assert gas["mean_absolute_error"] == pytest.approx(round(20 / 3))


def test_report_order(spark):
    ordered = evaluation.ordered_report(evaluation.metric_report(errors(spark))).collect()
    assert [(r["Upgrade ID"], r["Type"]) for r in ordered][:3] == [
        ("0.0", "Natural Gas"), ("0.0", "AC"), ("0.0", "Total"),
    ]
    assert ordered[-1]["Upgrade ID"] == "Total By Fuel"
    assert "Weighted Mean APE - Savings" in ordered[0].asDict()


def test_unpivot_and_pivot_agree_with_the_projection(spark):
    ids = list(evaluation.KEYS)
    long = evaluation.unpivot_pairs(wide(spark), ids, FUELS)
    paired = evaluation.pivot_fixed(long, [*ids, "fuel"], "target_type", ["actual", "prediction"])
    direct = evaluation.by_fuel(wide(spark), ids, FUELS, {"actual": "", "prediction": "-pred"})
    assert values(paired) == values(direct)


def test_benchmark(spark):
    benchmark = spark.createDataFrame(
        [(1, 0.0, 120.0, None, 30.0), (1, 1.0, 10.0, 60.0, 5.0)],
        "building_id int, upgrade_id double, kwh_upgrade_median double, kwh_delta_median double, absolute_error double",
    )
    df = evaluation.benchmark_errors(errors(spark), benchmark).where("fuel = 'total'")
    rows = {(r["model"], r["building_id"], r["upgrade_id"]): r for r in df.collect()}
    assert len(rows) == 10
    assert rows["Bucketed", 1, 0.0]["absolute_error"] == 30.0
    assert rows["Bucketed", 1, 1.0]["absolute_error"] is None
    assert rows["Bucketed", 1, 1.0]["absolute_error_savings"] == 10.0
    assert rows["Surrogate", 1, 1.0]["absolute_error"] == 5.0
    assert rows["Bucketed", 2, 3.0]["prediction"] is None


def test_benchmark_joined_before_fuels_are_multiplied_out(spark):
    benchmark = spark.createDataFrame(
        [(1, 0.0, 120.0, None, 30.0), (1, 1.0, 10.0, 60.0, 5.0)],
        "building_id int, upgrade_id double, kwh_upgrade_median double, kwh_delta_median double, absolute_error double",
    )
    based = evaluation.with_baselines(wide(spark), FUELS)
    found = evaluation.model_errors(evaluation.with_benchmark(based, benchmark), FUELS)
    expected = evaluation.benchmark_errors(errors(spark), benchmark)
    assert values(found.select(*expected.columns)) == values(expected)


def test_baselines_shuffle_a_building_once(spark):
    """Rows dealt by building are not shuffled again for their baselines."""
    rows = wide(spark).repartition(3, "building_id")
    plan = evaluation.with_baselines(rows, FUELS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan, plan


def test_baselines_of_rows_without_a_scenario_or_building(spark):
    rows = wide(spark).where("building_id = 1")
    odd = rows.withColumn("building_id", F.lit(None).cast("int")).unionByName(
        rows.withColumn("upgrade_id", F.lit(None).cast("double"))
    )
    found = evaluation.with_baselines(odd, FUELS).collect()
    assert len(found) == 2 * rows.count()
    for r in found:
        assert (r["total-base"] is None) == (r["upgrade_id"] is None)


def test_difference_of_reports(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, m double")
    new = spark.createDataFrame([("b", 5.0), ("c", 1.0)], "k string, m double")
    assert values(comparison.table_difference(old, new, ["k"])) == [
        ("a", None), ("b", 3.0), ("c", None),
    ]
    with pytest.raises(ValueError, match="same columns"):
        comparison.table_difference(old, new.withColumnRenamed("m", "n"), ["k"])


def test_versions_compare_savings_except_for_baselines(spark):
    stacked = comparison.stack_versions({"1": errors(spark), "2": errors(spark)})
    names = spark.createDataFrame(
        [(0.0, "Base"), (1.0, "One")], "upgrade_id double, upgrade_name string"
    )
    rows = comparison.comparable_errors(stacked, names)
    assert values(rows, "version", "upgrade_name", "baseline_fuel", "absolute_error") == [
        ("1", "Base (0.0)", "Natural Gas", 0.0),
        ("1", "One (1.0)", "Natural Gas", 5.0),
        ("2", "Base (0.0)", "Natural Gas", 0.0),
        ("2", "One (1.0)", "Natural Gas", 5.0),
    ]


def test_ordering_errors_against_pairs(spark):
    chance = random.Random(3)
    scenarios = (0.0, 1.0, 3.0, 11.05)
    rows = [
        (b, s, float(chance.randrange(6)), float(chance.randrange(6)))
        for b in range(40)
        for s in chance.sample(scenarios, chance.randrange(1, 5))
    ]
    df = spark.createDataFrame(rows, "building_id int, upgrade_id double, actual double, prediction double")
    found = comparison.ordering_errors(df, ["building_id"], "upgrade_id", scenarios)
    wrong = total = 0
    for b in range(40):
        for x, y in itertools.combinations([r for r in rows if r[0] == b], 2):
            total += 1
            wrong += (x[2] - y[2]) * (x[3] - y[3]) < 0
    row = comparison.global_ordering_error(found).first()
    assert (row["n_pairs"], row["error_rate"]) == (total, pytest.approx(wrong / total))
    rates = comparison.ordering_error_rates(found, "upgrade_id").agg(F.sum("occurrences")).first()
    assert rates[0] == 2 * total
    with pytest.raises(Exception, match="unknown scenario"):
        comparison.ordering_errors(df, ["building_id"], "upgrade_id", [0.0]).collect()


def test_repeated_rows_of_a_scenario_are_refused(spark):
    rows = [(1, 0.0, 10.0, 1.0), (1, 0.0, 1.0, 10.0), (1, 1.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "b int, s double, actual double, prediction double")
    with pytest.raises(Exception, match="several rows of one scenario"):
        comparison.ordering_errors(df, ["b"], "s", [0.0, 1.0]).collect()
    with pytest.raises(Exception, match="several rows of one scenario"):
        comparison.cross_scenario_trends(df, ["b"], "s", [0.0, 1.0]).collect()


def test_catalogues_of_any_size_are_compared(spark):
    rows = [(1, float(s), float(s), -float(s)) for s in range(70)]
    df = spark.createDataFrame(rows, "b int, s double, actual double, prediction double")
    found = comparison.ordering_errors(df, ["b"], "s", [float(s) for s in range(70)])
    assert comparison.global_ordering_error(found).first() == (1.0, 70 * 69 // 2)


def test_rows_of_a_null_group_have_baselines(spark):
    rows = spark.createDataFrame(
        [(None, 0, 5.0), (None, 1, 7.0), (2, 0, 1.0)], "b int, s int, v double"
    )
    found = evaluation.with_baseline_values(rows, ["b"], "s", {"base": "v"})
    assert values(found, "b", "s", "base") == sorted([(None, 0, 5.0), (None, 1, 5.0), (2, 0, 1.0)], key=str)


def test_no_pairs_is_no_error(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 1.0)], "b int, s double, actual double, prediction double")
    found = comparison.ordering_errors(df, ["b"], "s", [0.0])
    assert comparison.global_ordering_error(found).first() == (0.0, 0)


def test_end_use_report(spark):
    rows = spark.createDataFrame(
        [("heating", "Gas", 10.0, 12.0), ("heating", "Gas", 0.0, 1.0), ("hvac", "Gas", 10.0, 9.0)],
        "end_use string, type string, actual double, prediction double",
    )
    found = {(r["end_use"], r["type"]): r for r in evaluation.end_use_report(rows).collect()}
    assert set(found) == {("heating", "Gas"), ("heating", "Total"), ("hvac", "Total")}
    assert found["heating", "Gas"]["mape"] == pytest.approx(20.0)
    assert found["heating", "Gas"]["median_abs_error"] == 1.5
