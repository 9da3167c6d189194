"""Soil moisture on the calendar of bins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ("lat_i", "lon_i")


def daily_mean(df: DataFrame, values: Sequence[str] = ("s1",), t: str = "t", cell: Sequence[str] = CELL) -> DataFrame:
    """A3: means of calendar days."""
    return df.groupBy(F.to_date(t).alias("day"), *cell).agg(*(F.avg(v).alias(v) for v in values))


def check_calendar(bins: Sequence[date], days: int = 14) -> None:
    """Not empty, increasing, unique, exactly ``days`` apart."""
    if not bins:
        raise ValueError("no bins")
    for a, b in zip(bins, bins[1:], strict=False):
        if b - a != timedelta(days=days):
            raise ValueError(f"{a} and {b} are not {days} days apart")


def to_calendar(df: DataFrame, bins: Sequence[date], values: Sequence[str] = ("s1",), t: str = "t", cell: Sequence[str] = CELL, days: int = 14) -> DataFrame:
    """Means over [bin, bin + days); every cell has every bin, empty ones null."""
    check_calendar(bins, days)
    number = F.floor(F.datediff(F.to_date(t), F.lit(bins[0])) / days).cast("int")
    seen = df.withColumn("bin", number).where(F.col("bin").between(0, len(bins) - 1)).groupBy("bin", *cell).agg(*(F.avg(v).alias(v) for v in values))
    dense = df.select(*cell).distinct().select(*cell, F.explode(F.sequence(F.lit(0), F.lit(len(bins) - 1))).alias("bin"))
    return dense.join(seen, ["bin", *cell], "left").withColumn("bin_start", F.date_add(F.lit(bins[0]), F.col("bin") * days))


def change(df: DataFrame, value: str = "s1", order: str = "bin", cell: Sequence[str] = CELL, out: str = "delta_swi_14d") -> DataFrame:
    """The value less the one of the row before; the first is null."""
    if value not in df.columns:
        raise ValueError(f"{value} is needed")
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*cell).orderBy(order)))
