"""Streaming extension: stateless scans over a stream of files, and windowed event counts with a watermark.

The scan operators are projections, so they take a streaming DataFrame unchanged;
only roll-ups need a window.  These functions accept batch frames too, which is how
the registered queries run them over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total: tumbling windows; events later than ``late`` are dropped by a stream only."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end, n: runs of events of a user with gaps below ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def score_stream(files: DataFrame, analyzer: str) -> DataFrame:
    """Scores of one engine over a stream of files; no state is kept."""
    from adherix.operators.scan import scores

    return scores(files, analyzer)
