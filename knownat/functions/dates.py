"""Quarter arithmetic on plain integers: ``year * 4 + quarter - 1`` is a calendar position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lenient_date(value: Column | str) -> Column:
    """ISO date text to DATE, NULL when unreadable."""
    return _column(value).cast("string").try_cast("date")


def quarter_position(moment: Column | str) -> Column:
    m = _column(moment)
    return F.year(m) * 4 + F.quarter(m) - 1


def fiscal_position(year: Column | str, quarter_number: Column | str) -> Column:
    return _column(year).cast("int") * 4 + _column(quarter_number).cast("int")


def quarter_start(position: Column | str) -> Column:
    p = _column(position)
    return F.make_date(F.floor(p / 4).cast("int"), (p % 4 * 3 + 1).cast("int"), F.lit(1))


def quarter_end(moment: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(_column(moment), "quarter"), 2))


def calendar_quarter_label(moment: Column | str) -> Column:
    m = _column(moment)
    return F.concat(F.year(m).cast("string"), F.lit("Q"), F.quarter(m).cast("string"))
