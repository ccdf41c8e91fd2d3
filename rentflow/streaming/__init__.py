"""Structured Streaming forms of the table operators. State is keyed and bounded by watermarks, timers or the state table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching


def event_volume(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """(source_key, level, start, n) in windows of event time; on a stream, rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy(F.window("ts", width), "source_key", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source_key", "level", F.col("window.start").alias("start"), "n")


def new_tasks(urls: DataFrame, late: str = "1 day") -> DataFrame:
    """Discovered urls (external_id, url, seen_at), each task once within the watermark."""
    return urls.withColumn("task", F.coalesce("external_id", "url")).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["task"])


def match_new(listings: DataFrame, subs: DataFrame) -> DataFrame:
    """Pairs of a stream of new listings with a static table of filters, in append mode."""
    return matching.match(listings, subs)


from .caps import capped  # noqa: E402
from .state import StateTable, observe  # noqa: E402

__all__ = ["StateTable", "capped", "event_volume", "match_new", "new_tasks", "observe"]
