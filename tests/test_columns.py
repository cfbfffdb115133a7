from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.operators import audit, columns, vintages
from tests.conftest import values


def test_edit_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0, 4.0)],
        "`key.id` double, `drop.this` double, long_tail double, natural_gas_use double",
    )
    edited = columns.edit_columns(
        df, drop_matching=["drop__this"], strip=["_tail"], replace={"natural_gas": "methane"}
    )
    assert edited.columns == ["key__id", "long", "methane_use"]
    assert edited.collect()[0] == (1.0, 3.0, 4.0)
    assert columns.edit_columns(df, dot=".").columns == df.columns


def test_replacements_run_before_strips(spark):
    df = spark.createDataFrame([(1,)], "end_use_energy_use int")
    edited = columns.edit_columns(df, strip=["end_use_"], replace={"energy_use": "site"})
    assert edited.columns == ["site"]


def test_simulation_output_names(spark):
    names = [
        "building_id",
        *vintages.OUTPUT_JOB_COLUMNS,
        *[f"{family}x" for family in vintages.OUTPUT_DROP],
        *[f"{part}rest" for part in vintages.OUTPUT_STRIP],
        *[f"a_{part}_b" for part in vintages.OUTPUT_REPLACE],
    ]
    df = spark.createDataFrame([tuple(range(len(names)))], names)
    assert vintages.clean_outputs(df).columns == [
        "building_id",
        "rest",
        "rest",
        "rest",
        "a_out_b",
        "a_energy_consumption_m_btu_b",
        "a_hp_bkup_b",
        "a_site_energy_b",
    ]


def test_convert_units(spark):
    df = spark.createDataFrame(
        [(1e-6, 1.0, 1.0, 33.0, 5.0)],
        "energy_m_btu double, co2_lb double, power_btu_h double, temp_f double, other double",
    )
    row = columns.convert_units(df).first()
    assert row["energy_kwh"] == pytest.approx(columns.KWH_PER_BTU)
    assert row["co2_kg"] == pytest.approx(columns.KG_PER_POUND)
    assert row["power_kw"] == pytest.approx(columns.KWH_PER_BTU)
    assert row["temp_c"] == pytest.approx(5 / 9)
    assert row["other"] == 5.0


def test_union_reconciles_types(spark):
    a = spark.createDataFrame([(1, True)], "x long, y boolean")
    b = spark.createDataFrame([(1.5, 2, "z")], "x double, y long, z string")
    united = columns.union_tables([a, b])
    assert values(united) == [(1.0, 1.0, None), (1.5, 2.0, "z")]


def test_hopeless_types_are_an_error():
    schemas = [
        T.StructType([T.StructField("x", T.StringType())]),
        T.StructType([T.StructField("x", T.LongType())]),
    ]
    with pytest.raises(ValueError, match="x"):
        columns.reconcile_types(schemas)


def test_failed_runs_are_left_out(spark):
    df = spark.createDataFrame(
        [(1, "Success"), (2, "Fail")], "building_id long, completed_status string"
    )
    assert values(vintages.successful_runs(df, 11.05)) == [(1, "Success", 11.05)]


def test_fill_from_keeps_order(spark):
    df = spark.createDataFrame(
        [(None, "s1", 1, None), ("b", "s2", 2, "c")], "a string, source string, n int, d string"
    )
    filled = columns.fill_from(df, "source", ["a", "d"])
    assert filled.columns == df.columns
    assert values(filled) == [("b", "s2", 2, "c"), ("s1", "s1", 1, "s1")]
    assert values(columns.fill_from(df, "source", [])) == values(df)


def test_headers_and_suffix(spark):
    df = spark.createDataFrame([(1, 2)], "`Building Id` int, `Heat  Load` int")
    named = columns.normalise_headers(df)
    assert named.columns == ["building_id", "heat_load"]
    assert columns.suffix_columns(named, "__m", ["building_id"]).columns == [
        "building_id",
        "heat_load__m",
    ]


def test_categorical_difference(spark):
    left = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "p string, q string, n int")
    right = spark.createDataFrame([("b", "x"), ("c", "x")], "p string, q string")
    assert values(audit.categorical_difference(left, right)) == [
        ("p", "a", "left only"),
        ("p", "c", "right only"),
    ]
    assert audit.column_difference(left, right) == {"left only": {"n"}, "right only": set()}
    with pytest.raises(ValueError, match="one side"):
        audit.require_same_categories(left, right)
    audit.require_same_categories(left, right, exclude=["p"])


def test_null_audit(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert values(audit.null_counts(df)) == [("a", 0, 2), ("b", 1, 2)]
    with pytest.raises(ValueError, match="b"):
        audit.require_no_nulls(df)
    assert audit.require_no_nulls(df.select("a")).count() == 2


def test_feature_profile(spark):
    df = spark.createDataFrame(
        [(1, "x", "p"), (2, "y", "p"), (3, "x", None)], "id int, a string, b string"
    )
    assert audit.feature_profile(df) == {"numeric": 1, "categorical": 2, "dimensionality": 4}


def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, name string")
    assert values(audit.key_violations(df, ["id"])) == [(1, 2), (None, 1)]
    with pytest.raises(ValueError, match="not a key"):
        audit.require_key(df, ["id"])
    assert audit.require_key(df.where("id is not null"), ["id", "name"]).count() == 2


def test_alignment_keeps_columns_of_one_vintage(spark):
    base = {
        "building_id": 1,
        "clothes_washer": "Standard, 100% Usage",
        "clothes_dryer": "Gas, 80% Usage",
        "cooking_range": "Electric, 80% Usage",
        "dishwasher": "None",
        "refrigerator": "EF 10.2, 100% Usage",
        "hvac_has_ducts": "No",
        "water_heater_in_unit": "No",
        "misc_hot_tub_spa": "Gas",
        "misc_pool_heater": "Solar",
        "hvac_cooling_type": "Heat Pump",
        "hvac_heating_type_and_fuel": "Electricity MSHP",
        "hvac_heating_efficiency": "MSHP, SEER 14.5, 8.2 HSPF",
        "hvac_cooling_efficiency": "Non-Ducted Heat Pump",
    }
    older = spark.createDataFrame([base | {"ducts": "10% Leakage, R-4"}])
    newer = spark.createDataFrame(
        [base | {"duct_leakage_and_insulation": "None", "tenure": "Owner", "battery": "None"}]
    )
    rows = vintages.align_vintages(older, newer).orderBy(F.col("tenure").isNull()).collect()
    assert rows[0]["hvac_heating_type_and_fuel"] == "Electricity ASHP"
    assert rows[0]["hvac_cooling_efficiency"] == "Heat Pump"
    assert rows[0]["cooking_range"] == "Electric, 80% Usage"
    late = rows[1].asDict()
    assert late["tenure"] is None and "ducts" not in late and "battery" not in late
    assert late["cooking_range"] == "Electric Resistance"
    assert late["clothes_dryer"] == "Gas"
    assert late["duct_leakage_and_insulation"] == "10% Leakage to Outside, R-4"
    assert (late["duct_location"], late["water_heater_location"]) == ("None", "Outside")
    assert (late["misc_hot_tub_spa"], late["misc_pool_heater"]) == ("Natural Gas", "Other Fuel")
    assert late["hvac_cooling_type"] == "Ducted Heat Pump"
