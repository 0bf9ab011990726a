"""Streams: deduplicated event windows, ingestion status, incremental resumption. Structured Streaming throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, *, name: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The files of a folder with this name (or pattern) as a stream; each is taken once.

    Event times come without a zone and are taken in the session's; watermarks need that."""
    reader = spark.readStream.schema(EVENT).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Events that come again with the same id are dropped; state is forgotten after the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, *, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count, sum and mean by event type and window."""
    marked = events if events.isStreaming is False else events.withWatermark("ts", delay)
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "mean")


def sessions(events: DataFrame, *, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    out = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Process what there is and stop; a restart goes on where this ended."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
