"""The stream forms of the activity operators, on Structured Streaming with a watermark of ten minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def bursts(events: DataFrame, quiet: str = "100 milliseconds") -> DataFrame:
    """user, start, end, n: bursts of a stream of events (user, ts) without a longer pause."""
    w = F.session_window("ts", quiet)
    return events.withWatermark("ts", LATE).groupBy("user", w.alias("w")).agg(F.count("*").alias("n")).select("user", "w.start", "w.end", "n")


def recent(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """op, start, n: counts in sliding windows."""
    w = F.window("ts", window, slide)
    return events.withWatermark("ts", LATE).groupBy("op", w.alias("w")).agg(F.count("*").alias("n")).select("op", "w.start", "n")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each event once, of those that come within the watermark: feedback of a write is not seen as a new one."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)
