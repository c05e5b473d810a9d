"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column) -> Column:
    """Truncate toward zero."""
    return value.cast("bigint")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ratio(part: Column, total: Column) -> Column:
    """part / total as a double, 0 when the total is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for comparison and display; the addition turns a negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)


def softmax(scores: Column) -> Column:
    """Softmax over an array, shifted by its maximum."""
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def first_max_index(values: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")
