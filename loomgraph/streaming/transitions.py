"""The event log as a stream of graph edges: windowed transition counts, sessions and running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events of each type in tumbling (or sliding) windows; rows later than ``late`` are dropped by the watermark."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = ts.groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Sessions of each user: session_start, session_end, events. Without ``late`` no row is too late, and state is kept to the end."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and late:
        ts = ts.withWatermark("ts", late)
    out = ts.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def running_activation(stream: DataFrame) -> DataFrame:
    """The number and weight of each node's events so far, kept in Spark's own state store: the event-sourced ``activate``."""
    return stream.groupBy("event_type").agg(F.count("*").alias("events"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("weight"))


def replay(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that its source has now and end: each batch is written to ``folder``, or replaces it in complete mode."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(folder)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
