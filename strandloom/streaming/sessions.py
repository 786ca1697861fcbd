"""Gap clustering of an unbounded stream of positions in time. The reference has no streams; this is its gap chain with state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, gap: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of each session of events(ts, user_id); works on static and streaming frames."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
