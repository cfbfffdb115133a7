from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import calendar, lookup, text, water_heater


def read(spark, expression, label):
    """Value of an expression over one label."""
    df = spark.createDataFrame([(label,)], "label string")
    return df.select(expression("label").alias("value")).first()["value"]


@pytest.mark.parametrize(
    ("function", "label", "expected"),
    [
        (text.percentage, "100% Conditioned", 1.0),
        (text.percentage, "<10% Conditioned", 0.1),
        (text.percentage, "None", 0.0),
        (text.percentage, "10% Leakage, Uninsulated", 0.1),
        (text.vintage_midpoint, "<1940", 1930),
        (text.vintage_midpoint, "1960s", 1965),
        (text.r_value, "Finished, R-13", 13),
        (text.r_value, "Brick, 12-in, 3-wythe, R-15", 15),
        (text.r_value, "CMU, 6-in Hollow, Uninsulated", 0),
        (text.r_value, "2ft R10 Under, Horizontal", 10),
        (text.r_value, "None", 0),
        (text.cooling_eer, "AC, SEER 13", 11.375),
        (text.cooling_eer, "Heat Pump", 11.375),
        (text.cooling_eer, "Heat Pump, ASHP, SEER 20, 7.7 HSPF", 17.5),
        (text.cooling_eer, "Room AC, EER 10.7", 10.7),
        (text.cooling_eer, "AC, EER2 10", 10.4),
        (text.cooling_eer, "None", 999.0),
        (text.heating_fraction, "Fuel Furnace, 80% AFUE", 0.8),
        (text.heating_fraction, "ASHP, SEER 15, 9 HSPF", 2.638),
        (text.heating_fraction, "Electric Baseboard, 100% Efficiency", 1.0),
        (text.heating_fraction, "None", 9.0),
        (text.heating_percent_integer, "ASHP, SEER 15, 8.5 HSPF", 249),
        (text.heating_percent_integer, "Fuel Furnace, 80% AFUE", 80),
        (text.heating_percent_integer, "None", 999),
        (text.temperature_f, "70F", 70.0),
        (text.temperature_f, "-3F", -3.0),
        (text.wall_ratio_mean, "F9 B9 L9 R9", 9.0),
        (text.wall_ratio_total, "F12 B12 L12 R12", 48),
        (text.energy_factor, "EF 10.2, 100% Usage", 10.2),
        (text.energy_factor, "EF 6.7", 6.7),
        (text.energy_factor, "None", 99.0),
        (text.wall_finish_material, "Shingle, Asbestos, Medium", "Shingle-Asbestos"),
        (text.wall_finish_color, "Vinyl", "None"),
        (text.zone_type, "Daikin MSHP MZ, SEER 22.05, 11.2 HSPF", "MZ"),
        (text.prettify, "natural_gas", "Natural Gas"),
        (text.seer, "ASHP, SEER 15, 9.0 HSPF", 15.0),
        (text.hspf, "ASHP, SEER 15, 9.0 HSPF", 9.0),
        (text.afue, "Fuel Furnace, 80% AFUE", 80.0),
        (text.rated_eer_or_99, "SEER 16", 14.0),
        (text.rated_eer_or_99, "None", 99.0),
        (lookup.gisjoin_to_geoid, "G0200130", "02013"),
        (lookup.geoid_to_gisjoin, "42011", "G4200110"),
        (lookup.gisjoin_state, "G4200110", "PA"),
    ],
)
def test_label(spark, function, label, expected):
    found = read(spark, function, label)
    assert found == (pytest.approx(expected) if isinstance(expected, float) else expected)


@pytest.mark.parametrize(
    ("function", "label"),
    [
        (text.percentage, "a lot"),
        (text.r_value, "Brick"),
        (text.cooling_eer, "AC"),
        (text.heating_fraction, "Other"),
        (text.temperature_f, "warm"),
        (text.wall_ratio_mean, "Uninsulated"),
        (lookup.gisjoin_to_geoid, "0200130"),
        (lookup.gisjoin_state, "G0000000"),
        (lookup.gisjoin_state, "D0200130"),
    ],
)
def test_unreadable_label_is_null_or_fails(spark, function, label):
    assert read(spark, function, label) is None
    with pytest.raises(Exception, match="not a"):
        read(spark, lambda c: function(c, strict=True), label)


def test_null_labels_stay_null_in_strict_mode(spark):
    for function in (text.percentage, text.r_value, text.cooling_eer, text.heating_fraction):
        assert read(spark, lambda c: function(c, strict=True), None) is None


def test_offset_from_70(spark):
    assert read(spark, lambda c: text.temperature_f(c, relative_to=70.0), "60F") == -10.0


def test_ages(spark):
    assert read(spark, lambda c: text.age_in(c, 2000), "<1940") == 70
    assert read(spark, lambda c: text.age_in(c, 2010), "1960s") == 50


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("Natural Gas Tankless", ("Instantaneous", 0, 0.82, 1.0)),
        ("FIXME Fuel Oil Indirect", ("Storage", None, 0.62, 0.78)),
        ("Electric Heat Pump, 50 gal, 3.45 UEF", ("Heat Pump", 50, 3.57, 1.0)),
        ("Electric Heat Pump, 66 gal, 3.35 UEF", ("Heat Pump", 66, 3.449, 1.0)),
        ("Electric Heat Pump, 80 gal", ("Heat Pump", 80, 2.3, 1.0)),
    ],
)
def test_water_heater_specs(spark, label, expected):
    assert tuple(read(spark, water_heater.spec_struct, label)) == expected


@pytest.mark.parametrize(
    ("bedrooms", "bathrooms", "electric", "gallons"),
    [(1, 1.5, True, 20), (2, 2.5, True, 40), (3, 4.0, False, 40), (4, 3.0, True, 66), (6, 5.0, True, 80), (7, 4.0, True, None)],
)
def test_tank_gallons(spark, bedrooms, bathrooms, electric, gallons):
    df = spark.createDataFrame(
        [(bedrooms, bathrooms, electric)], "beds int, baths double, electric boolean"
    )
    found = df.select(water_heater.tank_gallons("beds", "baths", "electric")).first()[0]
    assert found == gallons


def test_heating_appliance(spark):
    rows = [
        ("Natural Gas Fuel Wall Furnace", "Natural Gas", "Wall Furnace"),
        ("Electricity Electric Furnace", "Electricity", "Furnace"),
        ("Fuel Oil Fuel Boiler", "Fuel Oil", "Boiler"),
        ("None", "None", "None"),
        ("Electricity ASHP", "Electricity", "ASHP"),
    ]
    df = spark.createDataFrame(rows, "label string, fuel string, expected string")
    found = df.select(text.heating_appliance("label", "fuel").alias("found"), "expected").collect()
    assert [r["found"] for r in found] == [r["expected"] for r in found]


def test_weekend_variants(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-07')) AS d")
    found = days.orderBy("d").select(
        calendar.weekend("d"), calendar.weekend("d", calendar.FRIDAY_SATURDAY)
    )
    assert [tuple(r) for r in found.collect()] == [
        (0, 0), (0, 0), (0, 0), (0, 0), (0, 1), (1, 1), (1, 0),
    ]


def test_degrees_are_named_for_what_they_are(spark):
    df = spark.createDataFrame([(75.0,), (40.0,)], "t double").select(
        calendar.cooling_degrees("t").alias("c"), calendar.heating_degrees("t").alias("h")
    )
    assert [tuple(r) for r in df.collect()] == [(10.0, 0.0), (0.0, 25.0)]


def test_unknown_step_is_an_error():
    assert calendar.step_length("M") == 730
    with pytest.raises(ValueError, match="granularity"):
        calendar.step_length("W")


def test_lookup_of_unknown_label_is_null_or_default(spark):
    assert read(spark, lambda c: lookup.look_up(c, lookup.YES_NO), "Maybe") is None
    assert read(spark, lambda c: lookup.look_up(c, lookup.USAGE_LEVEL, default=0), "?") == 0
    assert read(spark, lambda c: text.number_or(c, {"10+": 11}, "int"), "10+") == 11
    assert read(spark, lambda c: text.number_or(c, {"None": 9999.0}, "double"), "x") is None
    assert read(spark, lambda c: text.part_of(c, " ", 0, "int", default=0), "None") == 0
    assert read(spark, lambda c: F.upper(text.range_fuel(c)), "Electric Induction") == "ELECTRIC"
