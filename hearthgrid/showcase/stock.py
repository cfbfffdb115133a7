"""A building stock derived from ``customer``: every customer is one raw building.

Each raw column takes one of a few labels, chosen by arithmetic on the key, so the
stock grows with the table and SQL can derive the same one. Columns that share a
multiplier and a number of labels vary together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.showcase.base import table

Choices = Mapping[str, tuple[int, Sequence[str]]]

BOTH: Choices = {
    "bedrooms": (3, ("1", "2", "3", "4", "5")),
    "orientation": (
        5,
        ("North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest"),
    ),
    "geometry_garage": (11, ("None", "1 Car", "2 Car", "3 Car")),
    "window_areas": (
        13,
        ("F9 B9 L9 R9", "F12 B12 L12 R12", "F15 B15 L15 R15", "F6 B9 L12 R18", "F30 B30 L30 R30"),
    ),
    "windows": (
        17,
        (
            "Double, Low-E, H-Gain",
            "Double, Clear, Metal, Air",
            "Single, Clear, Metal",
            "Single, Clear, Non-metal",
            "Triple, Low-E, Non-metal, Air, L-Gain",
            "No Windows",
            "Unlisted",
        ),
    ),
    "heating_fuel": (
        7,
        (
            "Natural Gas",
            "Fuel Oil",
            "Propane",
            "Electricity",
            "Electricity",
            "Natural Gas",
            "None",
            "Electricity",
            "Other Fuel",
            "Natural Gas",
            "Fuel Oil",
        ),
    ),
    "hvac_heating_type_and_fuel": (
        7,
        (
            "Natural Gas Fuel Furnace",
            "Fuel Oil Fuel Boiler",
            "Propane Fuel Wall Furnace",
            "Electricity Baseboard",
            "Electricity Electric Furnace",
            "Natural Gas Fuel Furnace",
            "None",
            "Electricity ASHP",
            "Other Fuel Fireplace",
            "Natural Gas Fuel Boiler",
            "Fuel Oil Fuel Furnace",
        ),
    ),
    "hvac_heating_efficiency": (
        7,
        (
            "Fuel Furnace, 80% AFUE",
            "Fuel Boiler, 76% AFUE",
            "Fuel Wall/Floor Furnace, 60% AFUE",
            "Electric Baseboard, 100% Efficiency",
            "Electric Furnace, 100% AFUE",
            "Fuel Furnace, 92.5% AFUE",
            "None",
            "ASHP, SEER 15, 8.5 HSPF",
            "Other",
            "Fuel Boiler, 90% AFUE",
            "Fuel Furnace, 68% AFUE",
        ),
    ),
    "hvac_heating_type": (
        7,
        (
            "Ducted Heating",
            "Non-Ducted Heating",
            "Non-Ducted Heating",
            "Non-Ducted Heating",
            "Ducted Heating",
            "Ducted Heating",
            "None",
            "Ducted Heat Pump",
            "Non-Ducted Heating",
            "Non-Ducted Heating",
            "Ducted Heating",
        ),
    ),
    "hvac_cooling_efficiency": (
        19,
        ("AC, SEER 13", "AC, SEER 15", "Room AC, EER 10.7", "None", "AC, SEER 10"),
    ),
    "hvac_cooling_type": (19, ("Central AC", "Central AC", "Room AC", "None", "Central AC")),
    "hvac_cooling_partial_space_conditioning": (
        23,
        ("100% Conditioned", "<10% Conditioned", "60% Conditioned", "None"),
    ),
    "heating_setpoint": (29, ("68F", "70F", "72F", "55F")),
    "heating_setpoint_offset_magnitude": (31, ("0F", "3F", "6F", "12F")),
    "cooling_setpoint": (37, ("72F", "75F", "78F")),
    "cooling_setpoint_offset_magnitude": (41, ("0F", "2F", "5F", "9F")),
    "water_heater_fuel": (
        43,
        (
            "Natural Gas",
            "Natural Gas",
            "Electricity",
            "Electricity",
            "Fuel Oil",
            "Propane",
            "Electricity",
            "Electricity",
            "Other Fuel",
        ),
    ),
    "water_heater_efficiency": (
        43,
        (
            "Natural Gas Standard",
            "Natural Gas Tankless",
            "Electric Standard",
            "Electric Tankless",
            "Fuel Oil Standard",
            "Propane Premium",
            "Electric Heat Pump, 80 gal",
            "Electric Heat Pump, 50 gal, 3.45 UEF",
            "Other Fuel",
        ),
    ),
    "water_heater_in_unit": (47, ("Yes", "Yes", "Yes", "Yes", "Yes", "No")),
    "hvac_has_shared_system": (53, ("None", "None", "None", "None", "None", "Heating Only")),
    "vacancy_status": (59, ("Occupied", "Occupied", "Occupied", "Occupied", "Vacant")),
    "hvac_has_ducts": (61, ("Yes", "Yes", "Yes", "Yes", "Yes", "No", "No")),
    "infiltration": (
        67,
        ("4 ACH50", "7 ACH50", "8 ACH50", "10 ACH50", "12 ACH50", "15 ACH50", "20 ACH50"),
    ),
    "insulation_wall": (
        71,
        (
            "Wood Stud, Uninsulated",
            "Wood Stud, R-11",
            "Brick, 12-in, 3-wythe, R-15",
            "CMU, 6-in Hollow, Uninsulated",
        ),
    ),
    "insulation_foundation_wall": (73, ("Uninsulated", "Wall R-10, Interior", "None")),
    "insulation_slab": (79, ("Uninsulated", "2ft R10 Under, Horizontal", "None")),
    "insulation_rim_joist": (83, ("Uninsulated", "R-5, Exterior", "None")),
    "insulation_floor": (89, ("Uninsulated", "Ceiling R-19", "None")),
    "insulation_roof": (97, ("Finished, R-13", "Unfinished, Uninsulated")),
    "insulation_ceiling": (101, ("Uninsulated", "R-7", "R-13", "R-30", "R-38", "R-49", "None")),
    "geometry_building_type_acs": (
        103,
        (
            "Single-Family Detached",
            "Single-Family Attached",
            "Mobile Home",
            "2 Unit",
            "3 or 4 Unit",
            "Single-Family Detached",
            "50 or more Unit",
        ),
    ),
    "geometry_building_number_units_sfa": (
        103,
        ("None", "6", "None", "None", "None", "None", "None"),
    ),
    "geometry_building_number_units_mf": (
        103,
        ("None", "None", "None", "2", "4", "None", "50"),
    ),
    "geometry_building_horizontal_location_sfa": (
        103,
        ("None", "Middle", "None", "None", "None", "None", "None"),
    ),
    "geometry_building_horizontal_location_mf": (
        103,
        ("None", "None", "None", "Left", "Middle", "None", "Right"),
    ),
    "geometry_building_level_mf": (
        103,
        ("None", "None", "None", "Bottom", "Top", "None", "Middle"),
    ),
    "geometry_attic_type": (107, ("Vented Attic", "None", "Finished Attic or Cathedral Ceilings")),
    "geometry_foundation_type": (
        109,
        ("Slab", "Heated Basement", "Vented Crawlspace", "Unheated Basement"),
    ),
    "geometry_stories": (113, ("1", "2", "3")),
    "roof_material": (127, ("Asphalt Shingles, Medium", "Metal, Dark", "Tile, Clay or Ceramic")),
    "sqft": (131, ("328", "633", "885", "1220", "1690", "2663")),
    "ceiling_fan": (137, ("None", "Standard Efficiency")),
    "lighting": (139, ("100% CFL", "100% Incandescent", "100% LED")),
    "misc_extra_refrigerator": (149, ("None", "EF 6.7", "EF 15.9")),
    "misc_freezer": (151, ("None", "EF 12, National Average")),
    "misc_gas_fireplace": (157, ("None", "None", "None", "Gas Fireplace")),
    "misc_gas_grill": (163, ("None", "None", "Gas Grill")),
    "misc_gas_lighting": (167, ("None", "None", "None", "None", "Gas Lighting")),
    "misc_well_pump": (173, ("None", "Typical Efficiency")),
    "plug_loads": (179, ("78%", "100%", "121%")),
    "usage_level": (181, ("Low", "Medium", "High")),
    "ashrae_iecc_climate_zone_2004": (
        191,
        ("1A", "2A", "3B", "4A", "5A", "6A", "7B", "3C"),
    ),
    "neighbors": (193, ("None", "2", "12", "27", "Left/Right at 15ft")),
    "occupants": (197, ("1", "2", "3", "10+")),
    "vintage": (199, ("<1940", "1950s", "1980s", "2000s")),
    "weather_file_city": (211, ("City A", "City B", "City C", "City D", "City E")),
    "county": (223, ("G0100010", "G0600370", "G1700310", "G3600610", "G4802010")),
}

ONLY_2022: Choices = {
    "clothes_dryer": (227, ("Electric, 80% Usage", "Gas, 100% Usage", "None", "Propane, 120% Usage")),
    "clothes_washer": (229, ("Standard, 100% Usage", "EnergyStar, 80% Usage", "None")),
    "cooking_range": (233, ("Electric, 80% Usage", "Gas, 100% Usage", "Propane, 120% Usage")),
    "dishwasher": (239, ("290 Rated kWh, 80% Usage", "318 Rated kWh, 100% Usage", "None")),
    "refrigerator": (241, ("EF 10.2, 100% Usage", "EF 17.6, 95% Usage", "None")),
    "misc_hot_tub_spa": (251, ("None", "None", "Electric", "Gas")),
    "misc_pool_heater": (257, ("None", "None", "Electric", "Gas", "Solar")),
    "schedules": (263, ("Old Schedule",)),
    "hvac_secondary_heating_type_and_fuel": (269, ("None",)),
}
DUCTS_2022 = (271, ("10% Leakage, R-4", "30% Leakage, Uninsulated", "20% Leakage, R-6", "0% Leakage, Uninsulated"))

ONLY_2024: Choices = {
    "clothes_dryer": (227, ("Electric", "Gas", "None", "Propane")),
    "clothes_washer": (229, ("Standard", "EnergyStar", "None")),
    "cooking_range": (233, ("Electric Resistance", "Electric Induction", "Gas", "Propane")),
    "dishwasher": (239, ("290 Rated kWh", "318 Rated kWh", "None")),
    "refrigerator": (241, ("EF 10.2", "EF 21.9", "None")),
    "misc_hot_tub_spa": (251, ("None", "Electricity", "Natural Gas", "Other Fuel")),
    "misc_pool_heater": (257, ("None", "Electricity", "Natural Gas", "Other Fuel")),
    "clothes_dryer_usage_level": (263, ("Low", "High")),
    "battery": (269, ("None",)),
    "geometry_space_combination": (277, ("Void",)),
    "tenure": (281, ("Owner", "Renter")),
    "water_heater_location": (283, ("Attic", "Garage", "Living Space")),
}
DUCTS_2024 = (
    271,
    (
        "10% Leakage to Outside, R-6",
        "30% Leakage to Outside, Uninsulated",
        "20% Leakage to Outside, R-8",
        "0% Leakage to Outside, Uninsulated",
    ),
)
DUCT_PLACES_2024 = (293, ("Attic", "Crawlspace", "Garage"))


def _quoted(labels: Sequence[str]) -> str:
    return ", ".join(f"'{label}'" for label in labels)


def spark_pick(key: str, multiplier: int, labels: Sequence[str]) -> str:
    index = f"cast((({key} * {multiplier}) % 9973) % {len(labels)} as int) + 1"
    return f"element_at(array({_quoted(labels)}), {index})"


def duckdb_pick(key: str, multiplier: int, labels: Sequence[str]) -> str:
    index = f"cast((({key} * {multiplier}) % 9973) % {len(labels)} as integer) + 1"
    return f"list_extract([{_quoted(labels)}], {index})"


def derived_columns(choices: Choices, pick, key: str = "c_custkey") -> dict[str, str]:
    return {name: pick(key, *how) for name, how in choices.items()}


def _vintage_columns(year: int, pick) -> dict[str, str]:
    if year == 2022:
        columns = derived_columns({**BOTH, **ONLY_2022}, pick)
        ducts = {"ducts": pick("c_custkey", *DUCTS_2022)}
    else:
        columns = derived_columns({**BOTH, **ONLY_2024}, pick)
        ducts = {
            "duct_leakage_and_insulation": pick("c_custkey", *DUCTS_2024),
            "duct_location": pick("c_custkey", *DUCT_PLACES_2024),
        }
    has_ducts = columns["hvac_has_ducts"]
    return columns | {
        name: f"case when {has_ducts} = 'Yes' then {label} else 'None' end"
        for name, label in ducts.items()
    }


def raw_metadata(spark: SparkSession, folder: str, year: int, every: bool = False) -> DataFrame:
    """Raw metadata of one vintage: even customers are of 2022, odd ones of 2024.

    With ``every``, all customers take the form of the vintage.
    """
    columns = _vintage_columns(year, spark_pick)
    customers = table(spark, folder, "customer")
    if not every:
        customers = customers.where(F.col("c_custkey") % 2 == int(year == 2024))
    return customers.select(
        F.col("c_custkey").alias("bldg_id"),
        F.lit(1.0).alias("weight"),
        *[F.expr(text).alias(f"in.{name}") for name, text in columns.items()],
        F.col("c_acctbal").alias("out.electricity.total"),
    )


def raw_metadata_sql(year: int, every: bool = False) -> str:
    columns = _vintage_columns(year, duckdb_pick)
    chosen = "" if every else f" WHERE c_custkey % 2 = {int(year == 2024)}"
    picks = ",\n  ".join(f"{text} AS {name}" for name, text in columns.items())
    return (
        f"SELECT cast(c_custkey as integer) AS building_id,\n  {picks}\n"
        f"FROM customer{chosen}"
    )
