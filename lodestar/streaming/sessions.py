"""Sessions and change detection over streams: an extension of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day", key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, start, end, events, value): a key's events no further apart than the gap, emitted once no late event can join."""
    stamped = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    grouped = stamped.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def rolling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day", time: str = "ts") -> DataFrame:
    """(start, event_type, n): events of each kind by window."""
    stamped = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def follow(stream: DataFrame, known, apply, checkpoint: str):
    """A running query that hands each batch's diff against the current snapshot to apply(diff, seen, batch_id).

    known() gives the snapshot as it is; apply must be repeatable, as a batch may come again after a failure.
    """
    from ..operators.store import snapshot_diff

    def batch(seen: DataFrame, number: int) -> None:
        newest = seen.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "content_hash"), "mtime").alias("x")).select("path", "x.*")
        diff = snapshot_diff(known(), newest).where("change <> 'deleted'")
        apply(diff, newest, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
