"""Keyed changes of stored tables, expressed as new tables, and look-ups of rows by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(target: DataFrame, source: DataFrame, key: str, keep: list[str], overwrite: list[str] = ()) -> DataFrame:
    """`target` with the columns `keep` taken from `source` where it has a value, and `overwrite` taken from it wherever it has the key."""
    new = source.select(key, *(F.col(c).alias(f"_{c}") for c in (*keep, *overwrite)), F.lit(True).alias("_there"))
    joined = target.join(new, key, "left")
    cols = []
    for c in target.columns:
        if c in keep:
            cols.append(F.coalesce(f"_{c}", c).alias(c))
        elif c in overwrite:
            cols.append(F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


def gap_filled(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`target` with nulls and empty strings of `columns` filled from `source`."""
    new = source.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = target.join(new, key, "left")
    empty = lambda c: F.nullif(F.col(c), F.lit("")) if dict(target.dtypes)[c] == "string" else F.col(c)
    return joined.select(*(F.coalesce(empty(c), f"_{c}").alias(c) if c in columns else F.col(c) for c in target.columns))


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `source`, and those of `target` whose keys it doesn't have."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def inserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `target`, and of `source` one row for each new key; nulls count as equal in keys."""
    fresh = source.dropDuplicates(keys).alias("s")
    old = target.select(*keys).distinct().alias("t")
    same = None
    for k in keys:
        c = F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
        same = c if same is None else same & c
    return target.unionByName(fresh.join(old, same, "left_anti"))


def without(df: DataFrame, ids: DataFrame, key: str, id_key: str) -> DataFrame:
    """The rows of `df` that don't belong to `ids`."""
    return df.join(ids.select(F.col(id_key).alias(key)), key, "left_anti")


def last_rows(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the last by `order`. An aggregate, so that a key with many rows is reduced before it is shuffled."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def first_rows(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first by `order`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def find(docs: DataFrame, author: str | None = None, kind: str | None = None, years: str | None = None, doi: str | None = None) -> DataFrame:
    """The documents that fit all given criteria; `years` is one year or two with a hyphen, `author` a part of a name in any case."""
    out = docs
    if author:
        out = out.filter(F.exists("authors", lambda a: F.lower(a).contains(author.lower())))
    if kind:
        out = out.filter(F.col("du_document_type") == kind)
    if doi:
        out = out.filter(F.col("doi") == doi)
    if years:
        low, _, high = years.partition("-")
        out = out.filter(F.col("year").between(int(low), int(high or low)))
    return out
