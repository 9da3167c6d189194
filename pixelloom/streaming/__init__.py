"""Streaming forms of the daily mean and the 14-day bins.

An extension: the batch operators' results for data that arrives over time.  Bins are
anchored at a given day; ``F.window`` counts from 1970, so its start is shifted (S4).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_start(first: date, days: int) -> str:
    """The shift of epoch-anchored windows that makes one begin at ``first``."""
    return f"{(first - date(1970, 1, 1)).days % days} days"


def streaming_bins(events: DataFrame, value: str, first: date, cell: Sequence[str], days: int = 14, t: str = "t", late: str = "1 day") -> DataFrame:
    """(bin_start, cell, mean, count) of tumbling bins, final once the watermark has passed them."""
    bins = F.window(t, f"{days} days", startTime=window_start(first, days))
    out = events.withWatermark(t, late).groupBy(bins.alias("w"), *cell).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    return out.select(F.to_date("w.start").alias("bin_start"), *cell, "mean", "count")


def streaming_daily_mean(events: DataFrame, value: str, cell: Sequence[str], t: str = "t", late: str = "1 hour") -> DataFrame:
    """(day, cell, mean) of calendar days."""
    return streaming_bins(events, value, date(1970, 1, 1), cell, 1, t, late).select(F.col("bin_start").alias("day"), *cell, "mean")
