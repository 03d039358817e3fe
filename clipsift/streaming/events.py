"""Event-log operators that run on batches and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failure_windows(events: DataFrame, size: str, kind: str = "reject", slide: str | None = None) -> DataFrame:
    """(creator, window_start, failures) of each window of ``size``; on a stream give ``events`` a watermark on ts.

    Windows follow one another, or start every ``slide``; an event then counts in each window that it lies in.
    """
    found = events.where(F.col("event_type") == kind).groupBy("creator", F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return found.select("creator", F.col("w.start").alias("window_start"), "failures")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(creator, session_start, events): events of a creator that follow each other within ``gap``."""
    found = events.groupBy("creator", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return found.select("creator", F.col("w.start").alias("session_start"), "events")


def latest_by_clip(events: DataFrame) -> DataFrame:
    """The latest event of each clip; on a stream run it in update mode."""
    return events.groupBy("clip").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


def closed_once(events: DataFrame, within: str = "1 day") -> DataFrame:
    """Review-closing events, each clip's once; ``events`` needs a watermark on ts."""
    return events.where("event_type = 'review_closed_unselected'").withWatermark("ts", within).dropDuplicatesWithinWatermark(["clip"])
