"""Streams: documents that arrive in a folder become nodes and chunks; events are counted in windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import token_estimate
from ..sources import markdown


def arriving(spark: SparkSession, folder: str, schema, each: int = 100) -> DataFrame:
    """Parquet files of documents as they land, at most `each` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(folder)


def lines(documents: DataFrame) -> DataFrame:
    """One row a line with its token estimate; stateless, so it runs on a stream as on a table."""
    return markdown.lines(documents).where(F.trim("raw") != "").withColumn("tokens", token_estimate(F.col("raw")))


def ingest(documents: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the blocks of every micro-batch to target; the batch id makes a repeated batch overwrite itself."""

    def write(batch: DataFrame, number: int) -> None:
        markdown.blocks(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window; events later than the watermark are dropped by the engine."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    out = held.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100, 2).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events at most `gap` apart."""
    held = events.withWatermark("ts", gap) if events.isStreaming else events
    out = held.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
