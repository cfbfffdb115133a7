"""Error measures: row-level columns and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthgrid.functions.text import as_col

# Fixed value: actuals closer to zero than this have no percentage error.
NEAR_ZERO = 1e-3


def absolute_percentage_error(error: Column | str, actual: Column | str, eps: float = NEAR_ZERO):
    """Percent error; null where the error is null or the actual is about zero."""
    error, actual = as_col(error), as_col(actual)
    return F.when(F.abs(actual) >= eps, F.abs(F.try_divide(error, actual)) * 100)


def weighted_error(error: Column | str, actual: Column | str) -> Column:
    """Sum of errors over sum of absolute actuals (an aggregate)."""
    return F.try_divide(F.sum(as_col(error)), F.sum(F.abs(as_col(actual))))


def ratio_of_means(error: Column | str, actual: Column | str) -> Column:
    """Mean error over mean actual (an aggregate)."""
    return F.try_divide(F.avg(as_col(error)), F.avg(as_col(actual)))


def masked_mae(actual: Column | str, predicted: Column | str) -> Column:
    """Mean absolute error over rows whose actual is not zero; 0 if there are none."""
    actual, predicted = as_col(actual), as_col(predicted)
    return F.coalesce(F.avg(F.when(actual != 0, F.abs(actual - predicted))), F.lit(0.0))


def nonzero_mape(actual: Column | str, predicted: Column | str) -> Column:
    """Mean absolute percentage error over rows whose actual is not zero."""
    actual, predicted = as_col(actual), as_col(predicted)
    ratio = F.try_divide(actual - predicted, actual)
    return 100 * F.avg(F.when(actual != 0, F.abs(ratio)))


def row_sum(columns, ignore_null: bool = False) -> Column:
    """Sum across columns of one row."""
    terms = [as_col(c) for c in columns]
    if ignore_null:
        terms = [F.coalesce(t, F.lit(0.0)) for t in terms]
    return reduce(lambda a, b: a + b, terms)
