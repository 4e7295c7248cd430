"""Rolling windows over event streams: the batch windows of the panel, kept up to date by Structured Streaming.

State is bounded by the watermark: a window closes, and its state goes, once events that late are no longer
awaited. The same function serves batch and stream, so that a batch run is the oracle of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_shares(events: DataFrame, length: str = "12 days", slide: str = "3 days", late: str | None = "1 day") -> DataFrame:
    """(start, end, user_id, n, value, purchases): counts and sums by user in sliding windows."""
    if events.isStreaming and late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = events.groupBy(F.window("ts", length, slide).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("purchases"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "value", "purchases")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = "1 day") -> DataFrame:
    """(user_id, start, end, n): runs of events with no pause longer than gap."""
    if events.isStreaming and late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it has written (exactly once, by the checkpoint)."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
