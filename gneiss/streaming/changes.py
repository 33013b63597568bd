"""The change watcher as a structured stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending_changes(changes: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(path, ts) stream -> each path once within the watermark."""
    return changes.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["path"])


def debounced(changes: DataFrame, idle: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """(root, path, ts) stream -> a row for each burst of changes of a root that is followed by an idle time, with its paths."""
    bursts = changes.withWatermark("ts", watermark).groupBy("root", F.session_window("ts", idle))
    out = bursts.agg(F.collect_set("path").alias("paths"), F.count(F.lit(1)).alias("changes"))
    return out.select("root", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("idle_at"), F.sort_array("paths").alias("paths"), "changes")


def windowed_counts(events: DataFrame, key: str, size: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Events of a key in tumbling or sliding windows; an addition for event streams."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", watermark).groupBy(key, window).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "n")


def run_incrementally(bursts: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Calls index with the bursts of each micro-batch, one batch at a time; a restart goes on where the last one ended."""
    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(index).start()


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, modified_time) listings -> path, change: added, changed or deleted."""
    both = before.select("path", F.col("modified_time").alias("a")).join(now.select("path", F.col("modified_time").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")
