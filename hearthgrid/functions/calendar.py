"""Calendar keys and temperature-derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthgrid.functions.text import as_col

HOURS_IN_YEAR = 8760
# Spark counts days of the week from Sunday = 1.
SATURDAY_SUNDAY = (7, 1)
FRIDAY_SATURDAY = (6, 7)
# Steps of equal length that a year is cut into.
STEPS_PER_YEAR = {"D": 365, "M": 12, "Q": 4, "Y": 1}
# Fixed value: base temperature of the degree values, in Fahrenheit.
DEGREE_BASE_F = 65


def weekend(ts: Column | str, days: Sequence[int] = SATURDAY_SUNDAY) -> Column:
    """1 on weekend days. ``days=FRIDAY_SATURDAY`` gives the other published variant."""
    return F.dayofweek(as_col(ts)).isin(list(days)).cast("int")


def hour_key(ts: Column | str) -> Column:
    """Year-free hour label such as ``01-31-23:00``."""
    return F.date_format(as_col(ts), "MM-dd-HH:00")


def hour_of_year(ts: Column | str) -> Column:
    """0-based hour within the calendar year."""
    ts = as_col(ts)
    return (F.dayofyear(ts) - 1) * 24 + F.hour(ts)


def step_hour(ts: Column | str) -> Column:
    """0-based hour of a year of 365 days, the same that :func:`label_hour` gives its label.

    29 February counts as the 28th, so from then on a leap year's days have the numbers
    they have in any other year, and energy and weather of a day share a time step.
    """
    ts = as_col(ts)
    year = F.year(ts)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    day = F.dayofyear(ts) - F.when(leap & (F.dayofyear(ts) >= 60), 1).otherwise(0)
    return (day - 1) * 24 + F.hour(ts)


def label_hour(label: Column | str) -> Column:
    """0-based hour of a year of 365 days from an hour label; 29 February counts as the 28th."""
    label = as_col(label)
    day = F.substring(label, 1, 5)
    common = F.concat(F.lit("2001-"), F.when(day == "02-29", "02-28").otherwise(day))
    return (F.dayofyear(F.to_date(common)) - 1) * 24 + F.substring(label, 7, 2).cast("int")


def time_step(hour: Column | str, granularity: str) -> Column:
    """0-based time step of an hour of the year.

    Steps have equal length. Hours past 8760, which only a leap year's count reaches,
    belong to the last step, so no hour is lost and no further step opens.
    """
    last = STEPS_PER_YEAR.get(granularity, 1) - 1
    return F.least(F.floor(as_col(hour) / step_length(granularity)), F.lit(last)).cast("int")


def step_length(granularity: str) -> int:
    """Hours per time step of a year cut into equal steps."""
    if granularity not in STEPS_PER_YEAR:
        raise ValueError(f"granularity must be one of {sorted(STEPS_PER_YEAR)}")
    return HOURS_IN_YEAR // STEPS_PER_YEAR[granularity]


def celsius_to_fahrenheit(c: Column | str) -> Column:
    return as_col(c) * F.lit(9 / 5) + 32


def below(c: Column | str, limit: float) -> Column:
    return F.when(as_col(c) < limit, 1).otherwise(0)


def cooling_degrees(c: Column | str) -> Column:
    """Fahrenheit degrees above the base."""
    return F.greatest(as_col(c) - DEGREE_BASE_F, F.lit(0.0))


def heating_degrees(c: Column | str) -> Column:
    """Fahrenheit degrees below the base."""
    return F.greatest(F.lit(float(DEGREE_BASE_F)) - as_col(c), F.lit(0.0))
