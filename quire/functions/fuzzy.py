"""Degrees of truth between 0 and 1 as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def both(a: Column, b: Column) -> Column:
    return F.least(a, b)


def either(a: Column, b: Column) -> Column:
    return a + b - a * b


def negated(a: Column) -> Column:
    return 1 - a


def implies(a: Column, b: Column) -> Column:
    return F.greatest(1 - a, b)


def boosted(a: Column, weight: Column) -> Column:
    return a + weight * (1 - a)


def dampened(a: Column, weight: Column) -> Column:
    return a * (1 - weight)


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to `low`, 1 from `high`, straight between; a step where high <= low."""
    if high <= low:
        return F.when(x >= high, 1.0).otherwise(0.0)
    return clamp((x - low) / (high - low))
