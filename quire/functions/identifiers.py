"""Identifiers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of identifiers; group 1 is the identifier.
PATTERNS = {
    "doi": r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)",
    "isbn": r"\b(97[89][- ]?\d[- ]?\d{2,5}[- ]?\d{2,7}[- ]?\d{1,7}[- ]?\d)\b",
    "issn": r"\b(\d{4}-\d{3}[0-9Xx])\b",
    "arxiv": r"(?i)\barxiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)\b",
    "pmid": r"\bPMID[:\s]+(\d{6,8})\b",
}


def found(text: Column, kind: str) -> Column:
    """The distinct identifiers of one kind in a text, in their order; DOIs without trailing dots."""
    out = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1))
    return F.array_distinct(F.transform(out, lambda x: F.regexp_replace(x, r"\.+$", "")) if kind == "doi" else out)


def identifier_rows(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, kind, position, value): every identifier in a column of texts."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), found(F.col(text), k).alias("values")) for k in PATTERNS))
    rows = df.select(key, F.explode(kinds).alias("k")).select(key, "k.kind", F.posexplode("k.values").alias("position", "value"))
    return rows.select(key, F.lit(source).alias("source"), "kind", "position", "value")


def promoted(rows: DataFrame, key: str) -> DataFrame:
    """(key, doi, isbn, ...): the first identifier of each kind, one row for each key that has any."""
    firsts = (F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.struct("source", "position", "value"))).alias(k) for k in PATTERNS)
    return rows.groupBy(key).agg(*firsts)
