"""Arithmetic whose edge cases are NULL instead of an error or an infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def not_below_zero(c: Column) -> Column:
    """Clip at zero that leaves NULL alone (``greatest`` would turn it into zero)."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def relative_error(actual: Column, predicted: Column) -> Column:
    return ratio(actual - predicted, actual)


def day_accuracy(actual: Column, predicted: Column) -> Column:
    """One minus actual over predicted: the measure of the segment results."""
    return F.lit(1.0) - F.abs(ratio(actual, predicted))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
