"""Composition and rates of an event stream over event-time windows; late rows up to a watermark count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, ts: str, by: str, hit: Column, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, by, n, n_hit for each tumbling window; works on batch and streaming frames alike.

    Rows later than the watermark are left out of a stream; a batch has no late rows. Null times fall
    into no window.
    """
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hit"))
    return g.select(F.col("window.start").alias("start"), by, "n", "n_hit")
