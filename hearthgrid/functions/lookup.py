"""Small fixed dictionaries as map expressions, and county codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthgrid.functions.text import as_col, or_fail

# Answers, levels, compass headings and lamp efficiencies.
YES_NO = {"Yes": True, "No": False}
USAGE_LEVEL = {"Low": 1, "Medium": 2, "High": 3}
HEADING_DEGREES = {
    "North": 0,
    "Northeast": 45,
    "East": 90,
    "Southeast": 135,
    "South": 180,
    "Southwest": 225,
    "West": 270,
    "Northwest": 315,
}
LAMP_EFFICIENCY = {"100% CFL": 0.12, "100% Incandescent": 0.02, "100% LED": 0.15}

# Federal state codes of the counties.
STATE_LETTERS = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT",
    "10": "DE", "11": "DC", "12": "FL", "13": "GA", "16": "ID", "17": "IL", "18": "IN",
    "19": "IA", "20": "KS", "21": "KY", "22": "LA", "23": "ME", "24": "MD", "25": "MA",
    "26": "MI", "27": "MN", "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV",
    "33": "NH", "34": "NJ", "35": "NM", "36": "NY", "37": "NC", "38": "ND", "39": "OH",
    "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD", "47": "TN",
    "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA", "54": "WV", "55": "WI",
    "56": "WY",
}


def map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def look_up(c: Column | str, mapping: dict, default=None) -> Column:
    """Value of the label in ``mapping``; null or ``default`` where it is unknown."""
    found = map_literal(mapping)[as_col(c)]
    return found if default is None else F.coalesce(found, F.lit(default))


def relabel(c: Column | str, mapping: dict) -> Column:
    """Replace the labels in ``mapping``; all others stay as they are."""
    return F.coalesce(look_up(c, mapping), as_col(c))


def gisjoin_to_geoid(c: Column | str, strict: bool = False) -> Column:
    """``Gss0ccc0`` to ``ssccc``."""
    c = as_col(c)
    code = F.when(
        c.startswith("G") & (F.length(c) == 8), F.concat(F.substring(c, 2, 2), F.substring(c, 5, 3))
    )
    return or_fail(code, c, "county code", strict)


def geoid_to_gisjoin(c: Column | str) -> Column:
    c = as_col(c)
    return F.concat(F.lit("G"), F.substring(c, 1, 2), F.lit("0"), F.substring(c, 3, 3), F.lit("0"))


def gisjoin_state(c: Column | str, strict: bool = False) -> Column:
    """Two-letter state of a county code; malformed or unknown codes are invalid."""
    c = as_col(c)
    letters = F.when(
        c.rlike(r"^G\d{2}0\d{3}0"), map_literal(STATE_LETTERS)[F.substring(c, 2, 2)]
    )
    return or_fail(letters, c, "known county code", strict)
