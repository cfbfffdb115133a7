"""Typed baseline features of a building, all as native expressions in one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions import lookup, text, water_heater
from hearthgrid.sources.dimensions import windows

# Feature columns that name the fuel of an appliance.
APPLIANCE_FUELS = (
    "heating_fuel",
    "water_heater_fuel",
    "clothes_dryer_fuel",
    "cooking_range_fuel",
    "hot_tub_spa_fuel",
    "pool_heater_fuel",
)
GAS_INDICATORS = ("has_gas_fireplace", "has_gas_grill", "has_gas_lighting")
FUEL_NAMES = {"Gas": "Natural Gas", "Electric": "Electricity"}


def _is_present(name: str) -> Column:
    return F.col(name) != "None"


def _fuel(c: Column | str) -> Column:
    return lookup.relabel(c, FUEL_NAMES)


def _structure() -> dict[str, Column]:
    beds = F.col("bedrooms").try_cast("int")
    return {
        "n_bedrooms": beds,
        "n_bathrooms": beds / 2 + 0.5,
        "attic_type": F.col("geometry_attic_type"),
        "sqft": F.col("sqft").cast("double"),
        "foundation_type": F.col("geometry_foundation_type"),
        "garage_size_n_car": text.part_of("geometry_garage", " ", 0, "int", default=0),
        "n_stories": F.col("geometry_stories").cast("int"),
        "orientation_degrees": lookup.look_up("orientation", lookup.HEADING_DEGREES),
        "roof_material": F.col("roof_material"),
        "window_wall_ratio": text.wall_ratio_mean("window_areas", strict=True),
        "window_ufactor": F.col("window_ufactor"),
        "window_shgc": F.col("window_shgc"),
    }


def _heating() -> dict[str, Column]:
    appliance = text.heating_appliance("hvac_heating_type_and_fuel", "heating_fuel")
    return {
        "heating_fuel": _fuel("heating_fuel"),
        "heating_appliance_type": appliance,
        "heat_pump_sizing_methodology": F.when(appliance == "ASHP", "ACCA").otherwise("None"),
        "has_ducted_heating": F.col("hvac_heating_type").isin("Ducted Heat Pump", "Ducted Heating"),
        "heating_efficiency_nominal_percentage": text.heating_fraction(
            "hvac_heating_efficiency", strict=True
        ),
        "heating_setpoint_degrees_f": text.temperature_f("heating_setpoint", strict=True),
        "heating_setpoint_offset_magnitude_degrees_f": text.temperature_f(
            "heating_setpoint_offset_magnitude", strict=True
        ),
        "hvac_heating_efficiency": F.col("hvac_heating_efficiency"),
    }


def _cooling() -> dict[str, Column]:
    rated = F.when(
        F.col("hvac_cooling_efficiency") == "Heat Pump", F.col("hvac_heating_efficiency")
    ).otherwise(F.col("hvac_cooling_efficiency"))
    return {
        "ac_type": text.part_of("hvac_cooling_efficiency", ",", 0),
        "cooled_space_percentage": text.percentage(
            "hvac_cooling_partial_space_conditioning", strict=True
        ),
        "cooling_efficiency_eer": text.cooling_eer(rated, strict=True),
        "cooling_setpoint_degrees_f": text.temperature_f("cooling_setpoint", strict=True),
        "cooling_setpoint_offset_magnitude_degrees_f": text.temperature_f(
            "cooling_setpoint_offset_magnitude", strict=True
        ),
        "has_ducted_cooling": F.col("hvac_cooling_type").isin("Central AC", "Ducted Heat Pump"),
    }


def _water_heating() -> dict[str, Column]:
    beds = F.col("bedrooms").try_cast("int")
    spec = water_heater.specs("water_heater_efficiency")
    sized = water_heater.tank_gallons(
        beds, beds / 2 + 0.5, F.col("water_heater_fuel") == "Electricity"
    )
    spec["water_heater_tank_volume_gal"] = F.coalesce(spec["water_heater_tank_volume_gal"], sized)
    return {
        "water_heater_efficiency": F.col("water_heater_efficiency"),
        "water_heater_fuel": _fuel("water_heater_fuel"),
        **spec,
        "has_water_heater_in_unit": lookup.look_up("water_heater_in_unit", lookup.YES_NO),
        "water_heater_location": F.col("water_heater_location"),
    }


def _envelope() -> dict[str, Column]:
    insulation = {
        f"insulation_{part}_r_value": text.r_value(f"insulation_{part}", strict=True)
        for part in ("wall", "foundation_wall", "slab", "rim_joist", "floor", "roof", "ceiling")
    }
    return {
        "duct_leakage_and_insulation": F.col("duct_leakage_and_insulation"),
        "has_ducts": lookup.look_up("hvac_has_ducts", lookup.YES_NO),
        "duct_location": F.col("duct_location"),
        "duct_insulation_r_value": text.r_value(
            "duct_leakage_and_insulation", none_as=text.ABSENT["r_value"], strict=True
        ),
        "duct_leakage_percentage": text.percentage("duct_leakage_and_insulation", strict=True),
        "infiltration_ach50": text.part_of("infiltration", " ", 0, "int"),
        "insulation_wall": F.col("insulation_wall"),
        "wall_material": text.part_of("insulation_wall", ",", 0),
        **insulation,
    }


def _building_type() -> dict[str, Column]:
    kind = F.col("geometry_building_type_acs")

    def units(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("None"))

    return {
        "is_attached": ~kind.isin("Single-Family Detached", "Mobile Home"),
        "is_mobile_home": kind == "Mobile Home",
        "n_building_units": F.coalesce(
            units("geometry_building_number_units_sfa"),
            units("geometry_building_number_units_mf"),
            F.lit("1"),
        ).cast("int"),
        "is_middle_unit": (F.col("geometry_building_horizontal_location_sfa") == "Middle")
        | (F.col("geometry_building_horizontal_location_mf") == "Middle"),
        "unit_level_in_building": F.col("geometry_building_level_mf"),
    }


def _appliances() -> dict[str, Column]:
    return {
        "has_ceiling_fan": _is_present("ceiling_fan"),
        "clothes_dryer_fuel": _fuel("clothes_dryer"),
        "clothes_washer_efficiency": F.col("clothes_washer"),
        "cooking_range_fuel": _fuel(text.range_fuel("cooking_range")),
        "has_induction_range": F.col("cooking_range") == "Electric Induction",
        "dishwasher_efficiency_kwh": text.part_of(
            "dishwasher", " ", 0, "int", default=text.ABSENT["dishwasher_kwh"]
        ),
        "lighting_efficiency": lookup.look_up("lighting", lookup.LAMP_EFFICIENCY),
        "refrigerator_extra_efficiency_ef": text.energy_factor(
            "misc_extra_refrigerator", strict=True
        ),
        "has_standalone_freezer": _is_present("misc_freezer"),
        "has_gas_fireplace": _is_present("misc_gas_fireplace"),
        "has_gas_grill": _is_present("misc_gas_grill"),
        "has_gas_lighting": _is_present("misc_gas_lighting"),
        "has_well_pump": _is_present("misc_well_pump"),
        "hot_tub_spa_fuel": _fuel("misc_hot_tub_spa"),
        "pool_heater_fuel": _fuel("misc_pool_heater"),
        "refrigerator_efficiency_ef": text.energy_factor("refrigerator", strict=True),
        "plug_load_percentage": text.percentage("plug_loads", strict=True),
        "usage_level_appliances": lookup.look_up("usage_level", lookup.USAGE_LEVEL),
    }


def _surroundings() -> dict[str, Column]:
    return {
        "climate_zone_temp": text.zone_number("ashrae_iecc_climate_zone_2004"),
        "climate_zone_moisture": text.zone_moisture("ashrae_iecc_climate_zone_2004"),
        "neighbor_distance_ft": text.number_or(
            "neighbors",
            {"Left/Right at 15ft": 15.0, "None": text.ABSENT["neighbor_distance_ft"]},
            "double",
        ),
        "n_occupants": text.number_or("occupants", {"10+": 11}, "int"),
        "vintage": text.vintage_midpoint("vintage", strict=True),
    }


def building_features(metadata: DataFrame) -> DataFrame:
    """Baseline features of aligned metadata, keyed by building and building set.

    Buildings whose window label is unknown are left out by the inner join.
    """
    groups = (
        _structure,
        _heating,
        _cooling,
        _water_heating,
        _envelope,
        _building_type,
        _appliances,
        _surroundings,
    )
    expressions = {name: c for group in groups for name, c in group().items()}
    return metadata.join(F.broadcast(windows(metadata.sparkSession)), "windows").select(
        "building_id",
        "building_set",
        "weather_file_city",
        *[c.alias(name) for name, c in expressions.items()],
    )


def fuel_presence(fuels=APPLIANCE_FUELS, gas_flags=GAS_INDICATORS) -> dict[str, Column]:
    """Whether any appliance uses natural gas, fuel oil or propane; never null."""

    def used(fuel: str) -> Column:
        return F.coalesce(F.array_contains(F.array(*fuels), fuel), F.lit(False))

    any_gas_flag = F.coalesce(F.array_contains(F.array(*gas_flags), True), F.lit(False))
    return {
        "has_natural_gas_appliance": used("Natural Gas") | any_gas_flag,
        "has_fuel_oil_appliance": used("Fuel Oil"),
        "has_propane_appliance": used("Propane"),
    }
