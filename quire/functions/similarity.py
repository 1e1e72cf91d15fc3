"""How similar two strings are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.functions.text import token_set, word_count


def osa(a: str, b: str) -> int:
    """Edits between two strings, a swap of neighbours being one; no substring is edited twice.

    A row of the table at a time: what comes from the left is a running minimum.
    """
    if len(a) > len(b):
        a, b = b, a
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    short = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    steps = np.arange(len(codes) + 1)
    older = before = steps
    for i, x in enumerate(short, 1):
        row = np.empty_like(steps)
        row[0] = i
        row[1:] = np.minimum(before[:-1] + (codes != x), before[1:] + 1)
        if i > 1:
            swap = (codes[:-1] == x) & (codes[1:] == short[i - 2])
            row[2:][swap] = np.minimum(row[2:][swap], older[:-2][swap] + 1)
        row = np.minimum.accumulate(row - steps) + steps
        older, before = before, row
    return int(before[-1])


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def char_similarity(a: Column, b: Column) -> Column:
    """1 less the edits over the longer length; 1 of two empty strings."""
    size = F.greatest(F.length(a), F.length(b))
    return F.when(size == 0, 1.0).otherwise(1 - osa_distance(a, b) / size)


def word_overlap(a: Column, b: Column) -> Column:
    """Common words over all words; 1 of two texts without any."""
    x, y = token_set(a), token_set(b)
    all_ = F.size(F.array_union(x, y))
    return F.when(all_ == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / all_)


def title_similarity(a: Column, b: Column) -> Column:
    """Characters and words weighed: 0.60 and 0.40 where the shorter title has three words at most, else 0.35 and 0.65; numbers of sections are left out."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"^\s*\d+(?:\.\d+)*\.?\s+", ""))
    x, y = bare(a), bare(b)
    short = F.least(word_count(x), word_count(y)) <= 3
    chars, words = char_similarity(x, y), word_overlap(x, y)
    return F.when(short, 0.60 * chars + 0.40 * words).otherwise(0.35 * chars + 0.65 * words)


def reconciled(first: Column, first_sure: Column, second: Column, second_sure: Column) -> tuple[Column, Column]:
    """Of two findings of a title the surer one, with a confidence that agreement raises and conflict lowers."""
    x, y = token_set(first), token_set(second)
    all_ = F.size(F.array_union(x, y))
    shared = F.when(all_ == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / all_)
    best = F.greatest(first_sure, second_sure)
    sure = F.when(shared >= 0.8, F.least(F.lit(0.97), best + 0.20)).when(shared >= 0.4, F.least(F.lit(0.80), best + 0.10)).otherwise(F.greatest(F.lit(0.30), best - 0.05))
    value = F.when(second.isNull() | (first_sure >= second_sure), first).otherwise(F.coalesce(second, first))
    return F.when(first.isNull(), second).otherwise(value), F.when(first.isNull(), second_sure).when(second.isNull(), first_sure).otherwise(sure)
