"""Turning label text into typed columns.

Every function takes a Column (or a column name) and returns a Column built from
Spark's own expressions. With ``strict=True`` a non-null label that does not fit
the expected form fails the job; otherwise it becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Energy-efficiency-ratio equivalents of the cooling rating scales.
EER_PER_UNIT = {"SEER2": 0.91, "SEER": 0.875, "EER2": 1.04, "EER": 1.0}
# Fixed value: BTU per watt-hour, the scale of heating seasonal performance factors.
BTU_PER_WATT_HOUR = 3.412142
# The same constant as the two older generations used it.
OLDER_BTU_PER_WATT_HOUR = {"percent": 3.412, "integer": 3.413}
# What "there is none" stands for, per feature.
ABSENT = {
    "r_value": 999,
    "cooling_eer": 999.0,
    "heating_fraction": 9.0,
    "energy_factor": 99.0,
    "dishwasher_kwh": 9999,
    "neighbor_distance_ft": 9999.0,
}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grab(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The regex group, or null where the pattern does not occur."""
    return F.nullif(F.regexp_extract(as_col(c), pattern, group), F.lit(""))


def or_fail(parsed: Column, source: Column, what: str, strict: bool) -> Column:
    if not strict:
        return parsed
    message = F.concat(F.lit(f"not a {what}: "), source)
    return F.when(source.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def percentage(c: Column | str, strict: bool = False) -> Column:
    """``100% Conditioned`` to 1.0, ``<10% …`` to 0.1, ``None`` to 0."""
    c = as_col(c)
    number = grab(c, r"^<?(\d+)%").cast("double") / 100
    return or_fail(F.when(c == "None", 0.0).otherwise(number), c, "percentage", strict)


def vintage_midpoint(c: Column | str, strict: bool = False) -> Column:
    """Middle year of a decade label; the open first bin is 1930."""
    c = as_col(c)
    text = F.trim(c)
    year = F.when(text.startswith("<"), 1930).otherwise(
        F.substring(text, 1, 4).try_cast("int") + 5
    )
    return or_fail(year, c, "vintage", strict)


def age_in(c: Column | str, year: int) -> Column:
    """Age of the building in ``year``; the open first bin counts from 1930."""
    text = F.trim(as_col(c))
    return F.when(text.startswith("<"), year - 1930).otherwise(
        F.lit(year) - F.substring(text, 1, 4).try_cast("int")
    )


def r_value(c: Column | str, none_as: int = 0, strict: bool = False) -> Column:
    """Insulation R-value; uninsulated is 0, ``None`` is ``none_as``."""
    c = as_col(c)
    lower = F.lower(c)
    value = (
        F.when(lower == "none", F.lit(none_as))
        .when(lower.contains("uninsulated"), F.lit(0))
        .otherwise(grab(c, r"(?i)\bR-?(\d+)\b").cast("int"))
    )
    return or_fail(value, c, "R-value", strict)


def cooling_eer(c: Column | str, strict: bool = False) -> Column:
    """Cooling efficiency on the EER scale, three decimals."""
    c = as_col(c)
    kind = F.trim(F.substring_index(c, ", ", 1))
    rating = r"\b(SEER2|SEER|EER2|EER)\s+(\d+\.?\d*)"
    scale = F.create_map(*[F.lit(x) for pair in EER_PER_UNIT.items() for x in pair])
    rated = F.round(scale[grab(c, rating, 1)] * grab(c, rating, 2).cast("double"), 3)
    value = (
        F.when(kind == "None", F.lit(ABSENT["cooling_eer"]))
        .when(F.trim(c) == "Heat Pump", F.lit(13 * EER_PER_UNIT["SEER"]))
        .otherwise(rated)
    )
    return or_fail(value, c, "cooling efficiency", strict)


def heating_fraction(c: Column | str, strict: bool = False) -> Column:
    """Heating efficiency as a fraction of the input energy, three decimals."""
    c = as_col(c)
    rating = F.trim(F.substring_index(c, ", ", -1))
    number = grab(rating, r"^(\d+\.?\d*)%?(?: |$)").cast("double")
    value = (
        F.when(rating == "None", F.lit(ABSENT["heating_fraction"]))
        .when(rating.endswith("HSPF"), F.round(number / BTU_PER_WATT_HOUR, 3))
        .otherwise(F.round(number / 100, 3))
    )
    return or_fail(value, c, "heating efficiency", strict)


def heating_percent_integer(c: Column | str) -> Column:
    """The oldest form of heating efficiency: whole percent, ``None`` is 999."""
    rating = F.trim(F.substring_index(as_col(c), ", ", -1))
    number = grab(rating, r"^(\d+\.?\d*)%?(?: |$)").cast("double")
    return (
        F.when(rating == "None", F.lit(999))
        .when(
            rating.endswith("HSPF"),
            (number * 100 / OLDER_BTU_PER_WATT_HOUR["integer"]).cast("int"),
        )
        .otherwise(number.cast("int"))
    )


def heating_percent(c: Column | str) -> Column:
    """Older heating efficiency in percent: HSPF is converted, ``80%`` is read as is."""
    c = as_col(c)
    hspf_text = grab(c, r"(\d+\.?\d+|\d+) HSPF").cast("double")
    return F.when(
        c.contains("HSPF"), hspf_text * 100 / OLDER_BTU_PER_WATT_HOUR["percent"]
    ).otherwise(grab(c, r"(\d+\.?\d+)%").cast("double"))


def seer(c: Column | str) -> Column:
    """SEER rating held in the second comma-separated part."""
    part = F.get(F.split(as_col(c), ", "), F.lit(1))
    return F.when(part.contains("SEER"), F.get(F.split(part, " "), F.lit(1)).try_cast("double"))


def hspf(c: Column | str) -> Column:
    """HSPF rating held in the third comma-separated part."""
    part = F.get(F.split(as_col(c), ", "), F.lit(2))
    return F.when(part.contains("HSPF"), F.substring_index(part, " HSPF", 1).try_cast("double"))


def afue(c: Column | str) -> Column:
    """Percent rating held in the second comma-separated part."""
    part = F.get(F.split(as_col(c), ", "), F.lit(1))
    return F.when(part.contains("%"), F.substring_index(part, "%", 1).try_cast("double"))


def rated_eer_or_99(c: Column | str) -> Column:
    """Older cooling efficiency: label must start with the rating, anything else is 99."""
    c = as_col(c)
    start = r"^(SEER|EER)\s+([\d.]+)"
    number = grab(c, start, 2).try_cast("double")
    return F.coalesce(
        F.when(grab(c, start, 1) == "SEER", number * EER_PER_UNIT["SEER"]).otherwise(number),
        F.lit(99.0),
    )


def temperature_f(c: Column | str, relative_to: float = 0.0, strict: bool = False) -> Column:
    """``70F`` to 70.0, below-zero values included."""
    c = as_col(c)
    value = grab(c, r"^\s*(-?\d+(?:\.\d+)?)[Ff]\s*$").cast("double")
    return or_fail(value - relative_to if relative_to else value, c, "temperature", strict)


WALL_SIDES = 4


def wall_ratio_total(c: Column | str, strict: bool = False) -> Column:
    """Sum of the window-to-wall percentages of the four sides in ``F9 B9 L9 R9``.

    Spelled out side by side, because a lambda over the split label would keep the
    whole feature projection out of code generation.
    """
    c = as_col(c)
    sides = F.split(F.trim(c), r"\s+")
    terms = [
        F.substring(F.get(sides, F.lit(i)), 2, 9).try_cast("int") for i in range(WALL_SIDES)
    ]
    total = F.when(F.size(sides) == WALL_SIDES, terms[0] + terms[1] + terms[2] + terms[3])
    return or_fail(total, c, "window area", strict)


def wall_ratio_mean(c: Column | str, strict: bool = False) -> Column:
    return wall_ratio_total(c, strict).cast("double") / WALL_SIDES


def energy_factor(c: Column | str, strict: bool = False) -> Column:
    """``EF 10.2, 100% Usage`` to 10.2; labels with ``None`` are 99."""
    c = as_col(c)
    number = F.substring(F.substring_index(c, ",", 1), 4, 12).try_cast("double")
    value = F.when(c.contains("None"), F.lit(ABSENT["energy_factor"])).otherwise(number)
    return or_fail(value, c, "energy factor", strict)


def part_of(c: Column | str, separator: str, index: int, cast: str | None = None, default=None):
    """One piece of a split label, optionally cast, with a default where it is missing."""
    piece = F.get(F.split(as_col(c), separator), F.lit(index))
    if cast:
        piece = piece.try_cast(cast)
    return piece if default is None else F.coalesce(piece, F.lit(default))


def number_or(c: Column | str, special: dict, cast: str) -> Column:
    """Numeric label with a few labels standing for fixed numbers."""
    c = as_col(c)
    chain = None
    for label, value in special.items():
        hit = F.lit(value).cast(cast)
        chain = F.when(c == label, hit) if chain is None else chain.when(c == label, hit)
    return chain.otherwise(c.try_cast(cast))


def prettify(c: Column | str) -> Column:
    """``natural_gas`` to ``Natural Gas``."""
    return F.initcap(F.regexp_replace(as_col(c), "_", " "))


def zone_type(c: Column | str) -> Column:
    """Multi-zone or single-zone marker of a heat-pump label; empty if neither."""
    return F.regexp_extract(as_col(c), "(MZ|SZ)", 0)


def shingle_finish(c: Column | str) -> Column:
    """Exterior finish with the shingle kind kept in one piece."""
    return F.regexp_replace(as_col(c), "Shingle, ", "Shingle-")


def wall_finish_material(c: Column | str) -> Column:
    return part_of(shingle_finish(c), ", ", 0)


def wall_finish_color(c: Column | str) -> Column:
    return part_of(shingle_finish(c), ", ", 1, default="None")


def range_fuel(c: Column | str) -> Column:
    """Cooking range label without the element kind."""
    return F.regexp_replace(as_col(c), " Induction| Resistance", "")


def heating_appliance(type_and_fuel: Column | str, fuel: Column | str) -> Column:
    """Appliance class left after taking the fuel out of the combined label."""
    rest = F.replace(as_col(type_and_fuel), as_col(fuel), F.lit(""))
    chain = F.when(rest == "", "None")
    for kind in ("Wall Furnace", "Furnace", "Boiler"):
        chain = chain.when(rest.contains(kind), kind)
    return chain.otherwise(F.trim(rest))


def zone_number(c: Column | str) -> Column:
    return F.substring(as_col(c), 1, 1).try_cast("int")


def zone_moisture(c: Column | str) -> Column:
    return F.substring(as_col(c), 2, 1)
