"""Scenario rules on single homes: what each scenario changes, and that nothing else does."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hearthgrid.operators import older_scenarios, scenarios
from hearthgrid.sources.dimensions import COPS, HEAT_PUMP_CURVES, RETENTIONS
from tests.conftest import values

HOME = {
    "building_id": (1, "int"),
    "climate_zone_temp": (2, "int"),
    "attic_type": ("Vented Attic", "string"),
    "insulation_wall": ("Brick, R-13", "string"),
    "insulation_wall_r_value": (13, "int"),
    "insulation_ceiling_r_value": (15, "int"),
    "duct_insulation_r_value": (6, "int"),
    "duct_leakage_percentage": (0.2, "double"),
    "duct_leakage_and_insulation": ("20% Leakage to Outside, R-6", "string"),
    "infiltration_ach50": (12, "int"),
    "has_ducts": (True, "boolean"),
    "has_ducted_heating": (True, "boolean"),
    "has_ducted_cooling": (True, "boolean"),
    "heating_fuel": ("Natural Gas", "string"),
    "heating_appliance_type": ("Furnace", "string"),
    "heating_efficiency_nominal_percentage": (0.8, "double"),
    "cooling_efficiency_eer": (10.7, "double"),
    "ac_type": ("AC", "string"),
    "cooled_space_percentage": (0.5, "double"),
    "heat_pump_sizing_methodology": ("None", "string"),
    "cooling_setpoint_offset_magnitude_degrees_f": (3.0, "double"),
    "heating_setpoint_offset_magnitude_degrees_f": (9.0, "double"),
    "n_bedrooms": (3, "int"),
    "sqft": (1500.0, "double"),
    "water_heater_fuel": ("Natural Gas", "string"),
    "water_heater_efficiency": ("Natural Gas Premium", "string"),
    "water_heater_type": ("Storage", "string"),
    "water_heater_efficiency_ef": (0.67, "double"),
    "water_heater_recovery_efficiency_ef": (0.78, "double"),
    "water_heater_tank_volume_gal": (50, "int"),
    "clothes_dryer_fuel": ("Natural Gas", "string"),
    "cooking_range_fuel": ("Propane", "string"),
    "hot_tub_spa_fuel": ("None", "string"),
    "pool_heater_fuel": ("None", "string"),
    "has_gas_fireplace": (False, "boolean"),
    "has_gas_grill": (False, "boolean"),
    "has_gas_lighting": (False, "boolean"),
    "has_induction_range": (False, "boolean"),
    "hvac_heating_efficiency": ("Fuel Furnace, 80% AFUE", "string"),
}
SCHEMA = ", ".join(f"{name} {kind}" for name, (_, kind) in HOME.items())
CURVE = (*RETENTIONS, *COPS)


def homes(spark, *changes):
    rows = [tuple((dict.get(c, n, v) if n in c else v) for n, (v, _) in HOME.items()) for c in changes]
    return spark.createDataFrame(rows, SCHEMA)


def apply(spark, scenario, **changes):
    return scenarios.apply_scenario(homes(spark, changes), scenario).first().asDict()


def pump(label, heating, eer, key=None, sizing="HERS"):
    """What a heat-pump scenario sets."""
    return {
        "heating_fuel": "Electricity",
        "heating_appliance_type": "ASHP",
        "ac_type": "Heat Pump",
        "cooled_space_percentage": 1.0,
        "heat_pump_sizing_methodology": sizing,
        "heating_efficiency_nominal_percentage": heating,
        "cooling_efficiency_eer": eer,
        "hvac_heating_efficiency": key or label,
        **dict(zip(CURVE, HEAT_PUMP_CURVES[key or label])),
    }


NO_SETBACK = dict.fromkeys(scenarios.SETBACKS, 0.0)
DUCTLESS = {"has_ducted_heating": False, "has_ducted_cooling": False}
NO_DUCTS = {"has_ducts": False, **DUCTLESS}
ENCLOSED = {
    "insulation_ceiling_r_value": 49,
    "duct_insulation_r_value": 8.0,
    "duct_leakage_percentage": 0.1,
}
MEDIUM = pump("ASHP, SEER 18, 10 HSPF", 2.931, 15.75)
HIGH = pump("MSHP, SEER 24, 13 HSPF", 3.81, 21.0, sizing="ACCA")
WATER_50 = {
    "water_heater_fuel": "Electricity",
    "water_heater_type": "Heat Pump",
    "water_heater_efficiency_ef": 3.57,
    "water_heater_recovery_efficiency_ef": 1.0,
    "water_heater_tank_volume_gal": 50,
}

CASES = [
    (0.0, {}, {}),
    (0.01, {}, NO_SETBACK),
    (1.0, {}, ENCLOSED),
    (1.0, {"infiltration_ach50": 15}, ENCLOSED | {"infiltration_ach50": 10.5}),
    (1.0, {"climate_zone_temp": 1}, ENCLOSED | {"insulation_ceiling_r_value": 15}),
    (1.0, {"climate_zone_temp": 7}, ENCLOSED | {"insulation_ceiling_r_value": 60}),
    (1.0, {"attic_type": "None"}, ENCLOSED | {"insulation_ceiling_r_value": 15}),
    (1.0, {"insulation_ceiling_r_value": 35}, ENCLOSED | {"insulation_ceiling_r_value": 35}),
    (
        1.0,
        {"duct_leakage_and_insulation": "30% Leakage to Outside, Uninsulated"},
        {"insulation_ceiling_r_value": 49},
    ),
    (1.0, {"duct_insulation_r_value": 12}, ENCLOSED | {"duct_insulation_r_value": 12.0}),
    (1.0, NO_DUCTS, {"insulation_ceiling_r_value": 49}),
    (
        1.0,
        {"insulation_wall": "Wood Stud, Uninsulated", "insulation_wall_r_value": 0},
        ENCLOSED | {"insulation_wall_r_value": 13},
    ),
    (3.0, {}, pump("ASHP, SEER 15, 9 HSPF", 2.638, 13.125, sizing="ACCA")),
    (4.0, {}, HIGH),
    (
        4.0,
        NO_DUCTS,
        pump("", 4.103, 25.637, key="MSHP, SEER 24, 13 HSPF", sizing="ACCA"),
    ),
    (6.0, {}, WATER_50),
    (6.0, {"n_bedrooms": 4}, WATER_50 | {"water_heater_efficiency_ef": 3.449, "water_heater_tank_volume_gal": 66}),
    (6.0, {"n_bedrooms": 5}, WATER_50 | {"water_heater_tank_volume_gal": 80}),
    (
        6.0,
        {"water_heater_efficiency": "Electric Tankless"},
        WATER_50
        | {
            "water_heater_type": "Instantaneous",
            "water_heater_efficiency_ef": 0.99,
            "water_heater_tank_volume_gal": 0,
        },
    ),
    (
        9.0,
        {},
        ENCLOSED
        | HIGH
        | WATER_50
        | {
            "clothes_dryer_fuel": "Electricity",
            "cooking_range_fuel": "Electricity",
            "has_heat_pump_dryer": True,
            "has_induction_range": True,
        },
    ),
    (11.05, {}, MEDIUM | NO_SETBACK),
    (11.07, NO_DUCTS, pump("", 3.077, 15.75, key="ASHP, SEER 18, 10 HSPF") | NO_SETBACK),
    (13.01, {}, MEDIUM | NO_SETBACK | ENCLOSED),
    (13.02, {}, MEDIUM | NO_SETBACK | {"infiltration_ach50": 8.4}),
    (13.02, {"infiltration_ach50": 20}, MEDIUM | NO_SETBACK | {"infiltration_ach50": 12.0}),
    (13.02, {"infiltration_ach50": 8}, MEDIUM | NO_SETBACK | {"infiltration_ach50": 6.4}),
    (13.02, {"infiltration_ach50": 4}, MEDIUM | NO_SETBACK),
    (
        15.04,
        {"n_bedrooms": 1},
        pump("Daikin MSHP SZ, SEER 22.05, 10.64 HSPF", 3.118, 19.294) | NO_SETBACK | DUCTLESS,
    ),
    (
        15.04,
        {"n_bedrooms": 2, "sqft": 999.0},
        pump("Daikin MSHP SZ, SEER 22.05, 10.64 HSPF", 3.118, 19.294) | NO_SETBACK | DUCTLESS,
    ),
    (
        15.05,
        {},
        pump("Carrier MSHP MZ, SEER 26.25, 10.64 HSPF", 3.118, 22.969) | NO_SETBACK | DUCTLESS,
    ),
    (
        15.06,
        {"sqft": 700.0},
        pump("York MSHP SZ, SEER 23.625, 11.21 HSPF", 3.285, 20.672) | NO_SETBACK | DUCTLESS,
    ),
    (15.08, {}, pump("Daikin 7 series ASHP, SEER 20, 10.35 HSPF", 3.033, 17.5) | NO_SETBACK),
    (15.08, NO_DUCTS, NO_SETBACK),
    (15.08, {"has_ducts": None}, NO_SETBACK),
]


@pytest.fixture(scope="module")
def upgraded(spark):
    """All cases in one job: the building number is the case, its scenario is looked up."""
    numbered = [changes | {"building_id": i} for i, (_, changes, _) in enumerate(CASES)]
    ids = F.array(*[F.lit(scenario) for scenario, _, _ in CASES])
    df = homes(spark, *numbered).withColumn("upgrade_id", F.get(ids, F.col("building_id")))
    return {r["building_id"]: r.asDict() for r in scenarios.apply_scenarios(df).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scenario(upgraded, case):
    scenario, changes, expected = CASES[case]
    found = upgraded[case]
    home = {n: changes.get(n, v) for n, (v, _) in HOME.items()} | {"building_id": case}
    unchanged = {n: v for n, v in home.items() if n not in scenarios.LOOKUP_ONLY}
    curves = dict.fromkeys(RETENTIONS, 1.0) | dict.fromkeys(
        COPS, expected.get("heating_efficiency_nominal_percentage", 0.8)
    )
    wanted = {
        **unchanged,
        "upgrade_id": scenario,
        "has_heat_pump_dryer": False,
        **curves,
        **expected,
    }
    fuels = {wanted[f] for f in ("heating_fuel", "water_heater_fuel", "clothes_dryer_fuel", "cooking_range_fuel")}
    wanted |= {
        "has_natural_gas_appliance": "Natural Gas" in fuels,
        "has_propane_appliance": "Propane" in fuels,
        "has_fuel_oil_appliance": False,
    }
    assert set(found) == set(wanted)
    for name, value in wanted.items():
        assert found[name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_ductless_product_that_is_no_gain(spark):
    found = apply(
        spark,
        15.04,
        heating_efficiency_nominal_percentage=3.8,
        cooling_efficiency_eer=22.0,
        hvac_heating_efficiency="MSHP, SEER 24, 13 HSPF",
    )
    assert found["hvac_heating_efficiency"] == ""
    assert found["heating_efficiency_nominal_percentage"] == 3.8
    assert found["heating_appliance_type"] == "ASHP" and found["has_ducted_heating"] is True
    assert found["min_cop_47f"] == 3.8


def test_gas_indicator_counts_and_nulls_do_not(spark):
    nothing = dict.fromkeys(
        ("heating_fuel", "water_heater_fuel", "clothes_dryer_fuel", "cooking_range_fuel", "hot_tub_spa_fuel", "pool_heater_fuel")
    )
    assert apply(spark, 0, **nothing)["has_natural_gas_appliance"] is False
    assert apply(spark, 0, **nothing, has_gas_grill=True)["has_natural_gas_appliance"] is True


def test_unknown_scenario(spark):
    with pytest.raises(ValueError, match="unknown scenario"):
        scenarios.apply_scenario(homes(spark, {}), 2)
    with pytest.raises(Exception, match="unknown scenario"):
        scenarios.apply_scenarios(homes(spark, {}).withColumn("upgrade_id", F.lit(2.0))).collect()


def test_fan_out_by_building_set(spark):
    both = homes(spark, {}).withColumn("building_set", F.lit("ResStock 2022.1")).unionByName(
        homes(spark, {"building_id": 2}).withColumn("building_set", F.lit("ResStock 2024.2"))
    )
    found = scenarios.scenario_features(both)
    assert found.where("building_id = 1").count() == 8
    assert found.where("building_id = 2").count() == 7
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "CartesianProduct" not in plan
    assert "PythonUDF" not in plan


def test_unchanged_scenarios_are_dropped_with_all_copies_of_the_rest(spark):
    rows = [
        (1, 0.0, "a", None),
        (1, 0.0, "a", None),
        (1, 1.0, "a", None),
        (1, 3.0, "b", None),
        (1, 4.0, "b", None),
        (2, 1.0, "a", None),
    ]
    df = spark.createDataFrame(rows, "building_id int, upgrade_id double, x string, y string")
    assert values(scenarios.drop_unchanged(df)) == [rows[0], rows[0], rows[3], rows[5]]
    flagged = scenarios.flag_changed(df)
    assert values(flagged.where("not applicability"), "upgrade_id") == [(1.0,), (4.0,)]


def varied_homes(spark, n=150):
    """Homes of both sets that differ in what the rules look at, nulls included."""
    draw = random.Random(11)
    choices = {
        "climate_zone_temp": [1, 2, 5, None, 99],
        "attic_type": ["Vented Attic", "None", None],
        "insulation_wall": ["Wood Stud, Uninsulated", "Brick, R-13", None],
        "insulation_wall_r_value": [13, 0],
        "insulation_ceiling_r_value": [7, 38, None],
        "infiltration_ach50": [5, 8, 12, 15, 20, None],
        "has_ducts": [True, False, None],
        "duct_leakage_percentage": [0.1, 0.3, None],
        "duct_leakage_and_insulation": ["20% Leakage to Outside, R-6", "0% Leakage to Outside, Uninsulated", "None"],
        "heating_fuel": ["Electricity", "Natural Gas", "None"],
        "heating_appliance_type": ["ASHP", "Furnace"],
        "ac_type": ["Heat Pump", "AC"],
        "cooled_space_percentage": [1.0, 0.5],
        "heat_pump_sizing_methodology": ["ACCA", "HERS", "None"],
        "heating_efficiency_nominal_percentage": [0.8, 2.638, 3.9, None],
        "cooling_efficiency_eer": [10.7, 22.0, None],
        "cooling_setpoint_offset_magnitude_degrees_f": [0.0, 3.0],
        "heating_setpoint_offset_magnitude_degrees_f": [0.0, 9.0],
        "n_bedrooms": [1, 2, 4, 5],
        "sqft": [600.0, 900.0, 2000.0],
        "water_heater_fuel": ["Electricity", "Propane"],
        "water_heater_efficiency": ["Electric Tankless", "Electric Heat Pump, 50 gal, 3.45 UEF", "Natural Gas Premium"],
        "clothes_dryer_fuel": ["Electricity", "Natural Gas"],
        "cooking_range_fuel": ["Electricity", "Propane"],
        "has_induction_range": [True, False],
        "hvac_heating_efficiency": ["ASHP, SEER 15, 9 HSPF", "MSHP, SEER 24, 13 HSPF", "Fuel Furnace, 80% AFUE"],
    }
    changes = [{"building_id": i, **{k: draw.choice(v) for k, v in choices.items()}} for i in range(n)]
    even = F.when(F.col("building_id") % 2 == 0, scenarios.SET_2022).otherwise(scenarios.SET_2024)
    return homes(spark, *changes).withColumn("building_set", even)


def as_bag(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_variants_inside_the_row_are_those_of_the_aggregation(spark):
    some = varied_homes(spark)
    expected = as_bag(scenarios.drop_unchanged(scenarios.scenario_features(some)))
    assert as_bag(scenarios.changed_scenarios(some, unique=True)) == expected
    assert as_bag(scenarios.changed_scenarios(some)) == expected
    every = scenarios.scenario_features(some).count()
    assert len(expected) < every - 20
    flagged = scenarios.fan_out_flagged(some)
    assert flagged.count() == every
    keys = ["building_id", "building_set", "upgrade_id", "upgrade_name", "applicability"]
    assert values(flagged, *keys) == values(scenarios.flag_changed(scenarios.scenario_features(some)), *keys)


def test_rows_of_one_building_are_compared_with_each_other(spark):
    """Copies, a null key, and a building whose one row equals a variant of its other row."""
    some = varied_homes(spark, 40)
    sealed = some.where("building_id = 5").withColumn("infiltration_ach50", F.lit(20))
    better = sealed.withColumn("infiltration_ach50", F.lit(12))
    no_key = some.where("building_id < 4").withColumn("building_id", F.lit(None).cast("int"))
    rows = some.where("building_id <> 5").unionByName(sealed).unionByName(better).unionByName(no_key)
    rows = rows.unionByName(rows.where("building_id in (3, 8)"))
    expected = as_bag(scenarios.drop_unchanged(scenarios.scenario_features(rows)))
    assert as_bag(scenarios.changed_scenarios(rows)) == expected
    assert as_bag(scenarios.changed_scenarios(rows, unique=True)) != expected


def test_a_choice_of_scenarios_and_no_homes(spark):
    some = varied_homes(spark, 30)
    chosen = [0.0, 1.0, 9.0, 15.05]
    expected = as_bag(scenarios.drop_unchanged(scenarios.scenario_features(some, chosen)))
    assert as_bag(scenarios.changed_scenarios(some, chosen)) == expected
    assert scenarios.changed_scenarios(some.limit(0)).collect() == []


def test_unique_homes_are_not_shuffled(spark):
    plan = scenarios.changed_scenarios(varied_homes(spark, 5), unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan


def test_names_come_back(spark):
    df = spark.createDataFrame(
        [(1, 0.0, "Baseline", "a"), (1, 1.0, "Basic enclosure", "b")],
        "building_id int, upgrade_id double, upgrade_name string, x string",
    )
    assert values(scenarios.drop_unchanged(df)) == values(df)


def test_applicability_check(spark):
    flagged = spark.createDataFrame(
        [(1, 1.0, True), (2, 1.0, False), (3, 11.05, True)],
        "building_id int, upgrade_id double, applicability boolean",
    )
    simulated = flagged.withColumn("applicability", F.lit(True))
    assert values(scenarios.applicability_mismatches(flagged, simulated), "building_id") == [(2,)]
    with pytest.raises(ValueError, match="1 rows"):
        scenarios.require_applicability(flagged, simulated)


def test_numeric_scenarios_reject_others(spark):
    with pytest.raises(ValueError, match="unknown scenarios"):
        older_scenarios.numeric_scenarios(spark.range(1).toDF("id"), [2])
