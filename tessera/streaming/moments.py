"""Running A/B moments over an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, group: Column, value: str, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, group, n, mean, var for each tumbling window; works on streams (state ends at the watermark) and tables."""
    kept = events.withWatermark(time, late) if events.isStreaming else events
    at = F.window(F.col(time), window)
    out = kept.groupBy(at.alias("w"), group.alias("group")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    return out.select(F.col("w.start").alias("start"), "group", "n", "mean", "var")
