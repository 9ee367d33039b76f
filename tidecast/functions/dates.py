"""Calendar expressions. All take a DATE column and stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in reporting order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def iso_weekday(ds: Column) -> Column:
    """1 = Monday to 7 = Sunday."""
    return F.weekday(ds) + F.lit(1)


def weekday_name(ds: Column) -> Column:
    return F.date_format(ds, "EEEE")


def sunday_week(ds: Column) -> Column:
    """Week of the year with Sunday as first day; days before the first Sunday are week 0."""
    days_from_sunday = F.dayofweek(ds) - F.lit(1)
    return F.floor((F.dayofyear(ds) + F.lit(6) - days_from_sunday) / F.lit(7)).cast("int")


def month_start(ds: Column) -> Column:
    return F.trunc(ds, "MM")


def week_end(ds: Column) -> Column:
    """The Sunday that closes the week of ``ds``."""
    return F.date_add(ds, F.lit(6) - F.weekday(ds))


def year_fraction(ds: Column) -> Column:
    """Elapsed share of the calendar year, 366 days in leap years."""
    days = F.dayofyear(F.make_date(F.year(ds), F.lit(12), F.lit(31)))
    return (F.dayofyear(ds) - F.lit(1)) / days


def harmonics(cycles: Column, order: int) -> list[Column]:
    """sin and cos of the first ``order`` harmonics of a position counted in cycles."""
    out = []
    for k in range(1, order + 1):
        angle = cycles * F.lit(2 * math.pi * k)
        out += [F.sin(angle), F.cos(angle)]
    return out
