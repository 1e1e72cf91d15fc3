"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """A stored parquet table, or some of its columns."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
