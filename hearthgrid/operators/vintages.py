"""Building metadata: cleaning, eligibility, alignment of vintages and samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions.lookup import gisjoin_to_geoid, relabel
from hearthgrid.functions.text import part_of
from hearthgrid.operators.columns import (
    edit_columns,
    convert_units,
    normalise_headers,
    union_tables,
)
from hearthgrid.sources.dimensions import floor_area

# Building set names of the two metadata vintages.
SET_2022, SET_2024 = "ResStock 2022.1", "ResStock 2024.2"

# Name families of raw metadata columns that carry no input.
METADATA_DROP = (
    "simulation_control_run",
    "emissions",
    "weight",
    "applicability",
    "upgrade",
    "out__",
    "utility_bill",
    "metadata_index",
)
# Columns and name families of simulation output that are not kept.
OUTPUT_JOB_COLUMNS = ("job_id", "started_at", "completed_at", "completed_status", "step_failures")
OUTPUT_DROP = (
    "report_simulation_output_emissions_",
    "report_simulation_output_system_use_",
    "report_simulation_output_include_",
    "apply_upgrade",
    "utility_bills",
    "applicable",
    "upgrade_costs",
    "add_timeseries",
    "output_format",
)
OUTPUT_STRIP = ("qoi_report_qoi_", "end_use_", "fuel_use_")
OUTPUT_REPLACE = {
    "report_simulation_output": "out",
    "m_btu": "energy_consumption_m_btu",
    "heat_pump_backup": "hp_bkup",
    "energy_use": "site_energy",
}

# Building types that are modelled.
MODELED_TYPES = (
    "Single-Family Detached",
    "Single-Family Attached",
    "Mobile Home",
    "2 Unit",
    "3 or 4 Unit",
)


def _not_in(name: str, *labels: str) -> Column:
    return ~F.col(name).isin(*labels)


def eligible_homes() -> Column:
    """Occupied small buildings with modelled fuels and their own equipment."""
    return (
        F.col("geometry_building_type_acs").isin(*MODELED_TYPES)
        & _not_in("heating_fuel", "Other Fuel", "None")
        & (F.col("water_heater_fuel") != "Other Fuel")
        & _not_in("hvac_heating_type_and_fuel", "Electricity ASHP", "Electricity MSHP")
        & (F.col("vacancy_status") == "Occupied")
        & (F.col("hvac_has_shared_system") == "None")
        & (F.col("water_heater_in_unit") == "Yes")
    )


def eligible_attached_homes(prefix: str = "in_") -> Column:
    """Older set: attached homes without shared heating or cooling."""
    return (
        (F.col(f"{prefix}geometry_building_type_acs") == "Single-Family Attached")
        & _not_in(f"{prefix}heating_fuel", "Other Fuel")
        & (F.col(f"{prefix}hvac_cooling_type") != "Shared Cooling")
        & (F.col(f"{prefix}hvac_heating_efficiency") != "Shared Heating")
    )


def eligible_detached_homes() -> Column:
    """Oldest set: ordinary detached homes without solar panels."""
    return (
        (F.col("geometry_building_type_acs") == "Single-Family Detached")
        & (F.col("occupants") != "10+")
        & (F.col("geometry_stories") <= "5")
        & (F.col("sqft").cast("double") < 8000)
        & _not_in("hvac_heating_efficiency", "Other", "Shared Heating")
        & (F.col("hvac_cooling_efficiency") != "Shared Cooling")
        & (F.col("has_pv") == "No")
    )


ELIGIBILITY = {
    "current": eligible_homes,
    "attached": eligible_attached_homes,
    "detached": eligible_detached_homes,
}


def clean_metadata(raw: DataFrame) -> DataFrame:
    """Raw metadata to input columns of the eligible homes, keyed by ``building_id``."""
    named = edit_columns(raw, drop_matching=METADATA_DROP, strip=("in__",))
    inputs = named.select(
        *[c for c in named.columns if c != "bldg_id"],
        F.col("bldg_id").cast("int").alias("building_id"),
    )
    return inputs.where(eligible_homes())


def clean_outputs(raw: DataFrame) -> DataFrame:
    """Simulation output with short column names and without job columns."""
    return edit_columns(
        raw.drop(*OUTPUT_JOB_COLUMNS),
        drop_matching=OUTPUT_DROP,
        strip=OUTPUT_STRIP,
        replace=OUTPUT_REPLACE,
        dot="_",
    )


def successful_runs(raw: DataFrame, scenario_id: float) -> DataFrame:
    """Rows of completed simulations, tagged with the scenario they belong to."""
    done = raw.where(F.col("completed_status") == "Success") if (
        "completed_status" in raw.columns
    ) else raw
    return done.withColumn("upgrade_id", F.lit(scenario_id))


def combine_outputs(runs: Mapping[float, list[DataFrame]] | list[tuple[float, DataFrame]]) -> DataFrame:
    """All simulation outputs in one table with metric units."""
    pairs = (
        [(i, df) for i, dfs in runs.items() for df in dfs] if isinstance(runs, Mapping) else runs
    )
    united = union_tables([successful_runs(df, scenario_id) for scenario_id, df in pairs])
    return convert_units(clean_outputs(united))


# Columns that follow from others and are not kept.
REDUNDANT_2022 = ("hvac_secondary_heating_type_and_fuel", "schedules", "ducts")
REDUNDANT_2024 = (
    "battery",
    "geometry_space_combination",
    "hvac_secondary_heating_fuel",
    "hvac_secondary_heating_partial_space_conditioning",
)
# Appliances whose label carries a usage.
APPLIANCES_WITH_USAGE = (
    "clothes_dryer",
    "clothes_washer",
    "cooking_range",
    "dishwasher",
    "refrigerator",
)
# Fuel names of the later vintage.
FUEL_WORDS = {"Electric": "Electricity", "Gas": "Natural Gas"}


def _recoded_2022() -> dict[str, Column]:
    recodes = {c: part_of(c, ",", 0) for c in APPLIANCES_WITH_USAGE}
    recodes["cooking_range"] = relabel(
        recodes["cooking_range"], {"Electric": "Electric Resistance"}
    )
    return recodes | {
        "duct_leakage_and_insulation": F.regexp_replace("ducts", "Leakage", "Leakage to Outside"),
        "duct_location": F.when(F.col("hvac_has_ducts") == "Yes", "Unknown Location").otherwise(
            "None"
        ),
        "water_heater_location": F.when(
            F.col("water_heater_in_unit") == "Yes", "Inside Unit"
        ).otherwise("Outside"),
        "misc_hot_tub_spa": relabel("misc_hot_tub_spa", FUEL_WORDS),
        "misc_pool_heater": relabel("misc_pool_heater", FUEL_WORDS | {"Solar": "Other Fuel"}),
        "hvac_cooling_type": relabel("hvac_cooling_type", {"Heat Pump": "Ducted Heat Pump"}),
    }


def one_heat_pump_name() -> dict[str, Column]:
    """Heat-pump labels without the ducted/ductless distinction."""
    return {
        "hvac_heating_type_and_fuel": F.regexp_replace(
            "hvac_heating_type_and_fuel", "MSHP", "ASHP"
        ),
        "hvac_heating_efficiency": F.regexp_replace("hvac_heating_efficiency", "MSHP", "ASHP"),
        "hvac_cooling_efficiency": relabel(
            "hvac_cooling_efficiency",
            {"Non-Ducted Heat Pump": "Heat Pump", "Ducted Heat Pump": "Heat Pump"},
        ),
    }


def align_vintages(metadata_2022: DataFrame, metadata_2024: DataFrame) -> DataFrame:
    """Both vintages in one table with common labels, mostly those of 2024.

    Columns known to one vintage only are null in the other.
    """
    older = metadata_2022.withColumns(_recoded_2022()).drop(*REDUNDANT_2022)
    newer = metadata_2024.withColumns(one_heat_pump_name()).drop(
        *REDUNDANT_2024, *[f"{c}_usage_level" for c in APPLIANCES_WITH_USAGE]
    )
    return newer.unionByName(older, allowMissingColumns=True)


# Header corrections of sampled metadata.
SAMPLE_RENAMES = {
    "building": "bldg_id",
    "income_recs2015": "income_recs_2015",
    "income_recs2020": "income_recs_2020",
    "ashrae_iecc_climate_zone_2004_-_2a_split": "ashrae_iecc_climate_zone_2004_2_a_split",
}


def sampled_to_metadata(samples: DataFrame, counties: DataFrame) -> DataFrame:
    """Sampled buildings in the form of simulation metadata.

    Floor area comes from its 45-row table. ``counties`` maps ``county_geoid`` to
    the weather city; buildings of unknown counties are left out.
    """
    df = normalise_headers(samples).withColumnsRenamed(SAMPLE_RENAMES)
    county = part_of("county_and_puma", ",", 0)
    df = df.withColumns(
        {
            "heating_fuel": relabel("heating_fuel", {"Wood": "Other Fuel"}),
            **one_heat_pump_name(),
            "county": county,
            "county_geoid": gisjoin_to_geoid(county, strict=True),
        }
    )
    area = F.broadcast(floor_area(samples.sparkSession))
    return df.join(
        area, ["geometry_floor_area", "geometry_building_type_acs"], "left"
    ).join(counties, "county_geoid")
