"""Null-aware arithmetic: missing is NULL everywhere, never NaN, and nothing divides by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBABILITY_FLOOR = 1e-6


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    number = _column(value).cast("double")
    broken = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~broken, number)


def clean_number(value: Column | str) -> Column:
    """Lenient text-to-double; unreadable and non-finite input becomes NULL."""
    return finite(_column(value).cast("string").try_cast("double"))


def guarded_ratio(
    numerator: Column | str, denominator: Column | str, minimum: float = 0.0
) -> Column:
    """``numerator / denominator`` where ``|denominator| > minimum``, else NULL."""
    top, bottom = _column(numerator), _column(denominator)
    return F.when(F.abs(bottom) > F.lit(minimum), finite(top / bottom))


def round_half_away(value: Column | str, digits: int) -> Column:
    """Round the binary product ``value * 10**digits``, halves away from zero, as SQL engines do.

    Spark's own ``round`` goes by the shortest decimal text instead, so 0.285, whose product is
    28.499999999999996, gives 0.29 there and 0.28 here.
    """
    number = _column(value).cast("double")
    scale = F.lit(10.0**digits)
    product = F.abs(number) * scale
    below = F.floor(product)
    whole = F.when(product - below >= 0.5, below + 1).otherwise(below).cast("double")
    # Products of 2**52 and more and NaN have no fraction; one that overflows leaves the value.
    size = F.when(product < 2.0**52, whole).otherwise(product) / scale
    size = F.when(product == float("inf"), F.abs(number)).otherwise(size)
    return F.when(number < 0, 0.0 - size).otherwise(size) + 0.0


def flag(condition: Column) -> Column:
    """A comparison that is False, not NULL, when an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def null_aware_sum(*values: Column | str) -> Column:
    """Row sum over the present operands; NULL only when all are missing."""
    columns = [_column(v) for v in values]
    present = F.coalesce(*columns).isNotNull()
    total = F.coalesce(columns[0], F.lit(0.0))
    for column in columns[1:]:
        total = total + F.coalesce(column, F.lit(0.0))
    return F.when(present, total)


def clamp(value: Column | str, low: float | Column, high: float | Column) -> Column:
    """Clip to bounds while keeping NULL as NULL (``greatest`` alone would drop it)."""
    column = _column(value)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(column.isNotNull(), F.least(F.greatest(column, low), high))


def logit(probability: Column | str) -> Column:
    p = clamp(probability, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
    return F.log(p / (1 - p))


def sigmoid(value: Column | str) -> Column:
    return 1 / (1 + F.exp(-_column(value)))
