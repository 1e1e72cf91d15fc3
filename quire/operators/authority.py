"""Records of authorities held as tables: notations, names, canonical forms, and which authority answers for a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of a shelf-mark's notation and the numbers it may have.
NOTATION, LEAST, MOST = r"\b([A-Z]{2,3}) ?(\d{3,5})\b", 100, 99999


def notations(df: DataFrame, key: str, text: str, groups: list[str] | None = None) -> DataFrame:
    """(key, notation): the distinct notations in a text, of the given main groups (or all), with a number in range."""
    found = F.regexp_extract_all(F.col(text), F.lit(NOTATION), F.lit(0))
    rows = df.select(key, F.explode(F.array_distinct(found)).alias("n")).select(key, F.regexp_extract("n", NOTATION, 1).alias("a"), F.regexp_extract("n", NOTATION, 2).cast("int").alias("b"))
    rows = rows.filter(F.col("b").between(LEAST, MOST))
    if groups is not None:
        rows = rows.filter(F.col("a").isin(*groups))
    return rows.select(key, F.concat_ws(" ", "a", F.col("b").cast("string")).alias("notation")).distinct()


def name_parts(name: Column) -> tuple[Column, Column]:
    """Given and family name: parted at the comma, or before the last word."""
    text = F.trim(F.regexp_replace(name, r"\s+", " "))
    comma = text.contains(",")
    family = F.when(comma, F.trim(F.split(text, ",")[0])).otherwise(F.element_at(F.split(text, " "), -1))
    given = F.when(comma, F.trim(F.regexp_replace(text, "^[^,]*,", ""))).otherwise(F.regexp_replace(text, r" ?[^ ]+$", ""))
    return given, family


def canonical_isbn(value: Column) -> Column:
    """Capitals and digits of an ISBN; null unless there are ten or thirteen."""
    bare = F.regexp_replace(F.upper(value), "[^0-9X]", "")
    return F.when(F.length(bare).isin(10, 13), bare)


def canonical_doi(value: Column) -> Column:
    """A DOI in lower case without the address before it or dots after it; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), r"\.+$", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def entity_id(uri: Column) -> Column:
    """The last Q and number of an entity's address; null if it has none."""
    return F.nullif(F.regexp_extract(uri, r"/(Q\d+)$", 1), F.lit(""))


def year_of(literal: Column) -> Column:
    """The year that a date literal begins with; null if it begins with none."""
    return F.nullif(F.regexp_extract(literal, r"^\+?(\d{4})(?:\D|$)", 1), F.lit("")).cast("int")


RECORD = "title array<string>, author array<struct<given: string, family: string>>, `published-print` struct<`date-parts`: array<array<int>>>, `published-online` struct<`date-parts`: array<array<int>>>, issued struct<`date-parts`: array<array<int>>>"


def bibliographic(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, title, authors, year) of records in JSON: the year in print before that online before that of issue."""
    r = F.from_json(json, RECORD)
    year = lambda name: F.get(F.get(r[name]["date-parts"], F.lit(0)), F.lit(0))
    names = F.transform(r["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return df.select(key, F.get(r["title"], F.lit(0)).alias("title"), F.array_join(F.filter(names, lambda x: x != ""), "; ").alias("authors"), F.coalesce(year("published-print"), year("published-online"), year("issued")).alias("year"))


def resolved(rows: DataFrame, key: str, lookups: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, entity, by): the entity that the first lookup gives that has one. A lookup is a column of `rows` and a table (that column, entity); of several entities the smallest."""
    out = rows
    for column, table in lookups:
        one = table.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("entity").alias(f"_{column}"))
        out = out.join(one, column, "left")
    by = F.coalesce(*(F.when(F.col(f"_{c}").isNotNull(), F.lit(c)) for c, _ in lookups))
    return out.select(key, F.coalesce(*(F.col(f"_{c}") for c, _ in lookups)).alias("entity"), by.alias("by")).filter("entity is not null")


def status_rows(results: DataFrame, key: str, error: str, most: int = 800) -> DataFrame:
    """(key, status, message): done, or failed with the last `most` characters of the error."""
    failed = F.length(F.coalesce(F.col(error), F.lit(""))) > 0
    return results.select(key, F.when(failed, "failed").otherwise("done").alias("status"), F.when(failed, F.when(F.length(error) > most, F.substring(error, -most, most)).otherwise(F.col(error))).alias("message"))
