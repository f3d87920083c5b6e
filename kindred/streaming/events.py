"""Windowed counts over event streams and incremental maintenance of normalised records.

The functions take static or streaming frames alike; the watermark only matters for streams, whose
distinct counts are estimates under a name of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.roles import normalized


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp, with a watermark if the frame is a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total, users) in tumbling or sliding windows of event time.

    ``users`` is an exact count of distinct users. A stream cannot have one here; it has the estimate ``approx_users`` instead.
    """
    marked = _marked(events, late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    users, name = (F.approx_count_distinct("user_id"), "approx_users") if events.isStreaming else (F.countDistinct("user_id"), "users")
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), users.alias(name)).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total", name
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n) by gaps of inactivity."""
    marked = _marked(events, late)
    rows = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def maintain_views(records: DataFrame, path: str, checkpoint: str):
    """Writes normalised records as they arrive, a folder for each batch; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        normalized(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
