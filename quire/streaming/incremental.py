"""Documents as they arrive: a file stream deduplicated by content and counted by day of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """A stream of the parquet files put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def fresh(stream: DataFrame, time: str, content: str, lateness: str = "30 days") -> DataFrame:
    """The stream with a hash of the content, without repeats of a content within the lateness; rows later than that are dropped."""
    hashed = stream.withColumn("hash", F.sha2(F.col(content), 256)).withColumn("_time", F.col(time).cast("timestamp"))
    return hashed.withWatermark("_time", lateness).dropDuplicatesWithinWatermark(["hash"])


def by_day(stream: DataFrame, group: str) -> DataFrame:
    """Rows of each group by day, for a stream prepared by `fresh`."""
    return stream.groupBy(F.window("_time", "1 day").alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), group, "n")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is in the folder to the parquet table `target`, each row exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
