"""Predictions against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scores(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of each label; rows without truth are left out."""
    rows = df.filter(F.col(truth).isNotNull())
    both = rows.groupBy(truth, prediction).agg(F.count("*").alias("n"))
    sides = both.select(F.col(truth).alias("label"), F.when(F.col(truth) == F.col(prediction), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col(truth).eqNullSafe(F.col(prediction)), 0).otherwise(F.col("n")).alias("fn"))
    wrong = both.filter(F.col(prediction).isNotNull() & (F.col(truth) != F.col(prediction))).select(F.col(prediction), F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long"))
    total = sides.union(wrong).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def top_accuracy(df: DataFrame, truth: Column, first: Column, second: Column) -> DataFrame:
    """The share of rows whose truth is the first, and the first or second guess."""
    one, two = F.coalesce(truth == first, F.lit(False)), F.coalesce(truth == second, F.lit(False))
    return df.filter(truth.isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(one.cast("double")), 6).alias("top1"), F.round(F.avg((one | two).cast("double")), 6).alias("top2"))
