"""Structured Streaming forms of the event windows: each takes a batch or a streaming DataFrame alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Stream of event files; event time is an instant, as watermarks need it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling daily counts by type; on a stream, rows later than `late` are dropped with their state."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_means(events: DataFrame, length: str = "24 hours", step: str = "6 hours", late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "mean", "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def enriched(events: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Stream-static join."""
    return events.join(users, key, "left")


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
