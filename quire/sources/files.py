"""Readers of files: tables in CSV with required columns, and documents as binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """A CSV file with a header, all columns as text, a byte order mark ignored. Raises ValueError where a required column is missing; optional ones are null where they are."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    for c in df.columns:
        if c.startswith("﻿"):
            df = df.withColumnRenamed(c, c.lstrip("﻿"))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*required, *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional))


def document_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", with_content: bool = False) -> DataFrame:
    """(path, length, hash) of the files in a folder and those below it, with `content` if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("hash"), *(["content"] if with_content else []))


def truth(value: Column) -> Column:
    """Text as a boolean: 1, true, yes and y are true, all else false."""
    return F.lower(F.trim(value)).isin("1", "true", "yes", "y")
