"""Water-heater specifications read from the product label, and tank sizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthgrid.functions.text import as_col, grab, part_of

# Label -> (energy factor, recovery efficiency).
RATED = {
    "Natural Gas Standard": (0.59, 0.76),
    "Natural Gas Premium": (0.67, 0.78),
    "Natural Gas Tankless": (0.82, 1.0),
    "Propane Standard": (0.59, 0.76),
    "Propane Premium": (0.67, 0.78),
    "Propane Tankless": (0.82, 1.0),
    "Fuel Oil Standard": (0.62, 0.78),
    "Fuel Oil Premium": (0.68, 0.9),
    "FIXME Fuel Oil Indirect": (0.62, 0.78),
    "Electric Standard": (0.92, 1.0),
    "Electric Premium": (0.95, 1.0),
    "Electric Tankless": (0.99, 1.0),
    "Electric Heat Pump": (2.3, 1.0),
}
# Uniform energy factor to energy factor of a heat-pump water heater.
UEF_SLOPE, UEF_OFFSET = 1.2101, 0.6052
# Fixed values: (bedrooms, bathrooms below, gallons if electric, gallons otherwise).
TANK_GALLONS = [
    (1, None, 20, 20),
    (2, 2, 30, 30),
    (2, 3, 40, 30),
    (2, None, 50, 40),
    (3, 2, 40, 30),
    (3, None, 50, 40),
    (4, 3, 50, 40),
    (4, None, 66, 50),
    (5, None, 66, 50),
    (6, None, 80, 50),
]
SPEC_FIELDS = (
    "water_heater_type",
    "water_heater_tank_volume_gal",
    "water_heater_efficiency_ef",
    "water_heater_recovery_efficiency_ef",
)


def tank_gallons(bedrooms, bathrooms, electric) -> Column:
    """Recommended tank size; null beyond six bedrooms."""
    bedrooms, bathrooms, electric = as_col(bedrooms), as_col(bathrooms), as_col(electric)
    chain = F.when(F.lit(False), F.lit(None).cast("int"))
    for beds, baths_below, with_power, with_fuel in TANK_GALLONS:
        applies = bedrooms == beds
        if baths_below is not None:
            applies = applies & (bathrooms < baths_below)
        chain = chain.when(applies, F.when(electric, with_power).otherwise(with_fuel))
    return chain


def specs(c: Column | str) -> dict[str, Column]:
    """The four specification columns of a water-heater label."""
    c = as_col(c)
    product = part_of(c, ", ", 0)
    rated = F.create_map(
        *[
            x
            for label, (factor, recovery) in RATED.items()
            for x in (F.lit(label), F.struct(F.lit(factor).alias("ef"), F.lit(recovery).alias("re")))
        ]
    )[product]
    uniform = grab(part_of(c, ", ", 2), r"(\d+\.\d+)\s*UEF").cast("double")
    tankless = product.contains("Tankless")
    return {
        "water_heater_type": F.when(tankless, "Instantaneous")
        .when(product == "Electric Heat Pump", "Heat Pump")
        .when(product.isNotNull(), "Storage"),
        "water_heater_tank_volume_gal": F.coalesce(
            grab(part_of(c, ", ", 1), r"(\d+)\s*gal").cast("int"), F.when(tankless, 0)
        ),
        "water_heater_efficiency_ef": F.coalesce(
            F.round(uniform * UEF_SLOPE - UEF_OFFSET, 3), rated["ef"]
        ),
        "water_heater_recovery_efficiency_ef": F.when(
            product.isNotNull(), F.coalesce(rated["re"], F.lit(1.0))
        ),
    }


def spec_struct(c: Column | str) -> Column:
    return F.struct(*[value.alias(name) for name, value in specs(c).items()])
