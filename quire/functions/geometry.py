"""Rectangles and ranges as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two ranges have in common."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The common length over the shorter range; 0 of an empty one."""
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, overlap(a0, a1, b0, b1) / short).otherwise(0.0)


def common_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])
