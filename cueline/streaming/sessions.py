"""Sessions of events as they arrive, with late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arriving_sessions(events: DataFrame, item: str, time: str, gap: str, late: str) -> DataFrame:
    """``item``, ``begins``, ``ends`` (the last event's time plus the gap) and ``n`` of each session of a stream.

    An event within ``gap`` of two sessions joins them. A session comes out once, when the watermark (the latest time less ``late``) has passed its end;
    events behind the watermark are left out. Null times are left out.
    """
    within = F.session_window(time, gap)
    counts = events.withWatermark(time, late).groupBy(item, within.alias("within")).agg(F.count("*").alias("n"))
    return counts.select(item, F.col("within.start").alias("begins"), F.col("within.end").alias("ends"), "n")
