"""Event streams: the same transformations serve batch frames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a stream of files has of each.
FILE = "path string, modificationTime timestamp, length long, content binary"


def trend(events: DataFrame, every: str, late: str | None = None) -> DataFrame:
    """Counts and sums of each type in windows; `late` bounds the state of a stream."""
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each user, which a gap ends."""
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def arrivals(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Files as they arrive under a path, each content once within the time of `late`."""
    files = spark.readStream.schema(FILE).format("binaryFile").load(path)
    return files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])
