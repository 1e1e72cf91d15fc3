"""Terms typed by people, in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_terms(terms: Column) -> Column:
    """The array's elements in lower case, without spaces at their ends and with runs of spaces made one; nulls and empty ones left out."""
    one = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", " "))
    return F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), one), lambda x: F.length(x) > 0)
