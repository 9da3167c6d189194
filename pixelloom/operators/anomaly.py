"""Climatologies and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.errors import DataCompletenessError
from pixelloom.functions.indices import STD_FLOOR, standardised

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_steps(df: DataFrame, t: str = "t") -> DataFrame:
    """The months that a series has, with the number of its distinct time steps in each."""
    return df.select(F.trunc(t, "month").alias("month_start"), F.col(t).alias("step")).groupBy("month_start").agg(F.count_distinct("step").alias("steps"))


def month_gaps(df: DataFrame, start: str, end: str, t: str = "t") -> DataFrame:
    """(month_start, problem) of months that are missing or have several steps."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    wanted = df.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month_start"))
    have = month_steps(df.where(F.col(t).between(first, F.last_day(last))), t)
    missing = wanted.join(have, "month_start", "left_anti").select("month_start", F.lit("missing").alias("problem"))
    return missing.unionByName(have.where("steps > 1").select("month_start", F.lit("repeated").alias("problem")))


def require_months(df: DataFrame, start: str, end: str, t: str = "t") -> None:
    """Raise unless every month of the span is there once."""
    bad = [(r["problem"], str(r["month_start"])[:7]) for r in month_gaps(df, start, end, t).orderBy("month_start").collect()]  # months of the span at most
    if bad:
        raise DataCompletenessError("; ".join(f"{kind}: {month}" for kind, month in bad))


def climatology(df: DataFrame, value: str, cell: Sequence[str], t: str = "t", floor: float = STD_FLOOR) -> DataFrame:
    """A4: (month, cell, mean, std, count, invariant) by month of the year; std is of the population (S3)."""
    out = df.groupBy(F.month(t).alias("month"), *cell).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count"))
    return out.withColumn("invariant", F.coalesce(F.col("std") <= floor, F.lit(True)))


def invariant_count(clim: DataFrame) -> DataFrame:
    """The audit that goes with A4: cell-months without variance."""
    return clim.agg(F.count_if("invariant").alias("invariant_pixel_count"), F.count(F.lit(1)).alias("pixel_months"))


def require_baseline(target: DataFrame, clim: DataFrame, t: str = "t") -> None:
    """Raise if the climatology lacks a month that the target has."""
    gone = target.select(F.month(t).alias("month")).distinct().join(clim.select("month").distinct(), "month", "left_anti")
    months = sorted(r["month"] for r in gone.collect())  # twelve at most
    if months:
        raise KeyError(f"no baseline for months {months}")


def zscore(target: DataFrame, clim: DataFrame, value: str, cell: Sequence[str], t: str = "t", floor: float = STD_FLOOR, out: str = "z", monthly: bool = True) -> DataFrame:
    """The target against the baseline of its month, or one baseline for all times."""
    keys = ["month", *cell] if monthly else list(cell)
    rows = target.withColumn("month", F.month(t)) if monthly else target
    joined = rows.join(clim.select(*keys, F.col("mean").alias("_mean"), F.col("std").alias("_std")), keys)
    return joined.withColumn(out, standardised(F.col(value), F.col("_mean"), F.col("_std"), floor)).drop("_mean", "_std")


def clim_long(wide: DataFrame, cell: Sequence[str]) -> DataFrame:
    """P7, one column for each month and statistic, to (month, cell, mean, std, count)."""
    there = [(k + 1, m) for k, m in enumerate(MONTHS) if f"mean_{m}" in wide.columns]
    rows = F.array(*(F.struct(F.lit(k).alias("month"), F.col(f"mean_{m}").alias("mean"), F.col(f"stddev_{m}").alias("std"), F.col(f"count_{m}").alias("count")) for k, m in there))
    return wide.select(*cell, F.explode(rows).alias("x")).select("x.month", *cell, "x.mean", "x.std", "x.count")


def clim_qa(clim: DataFrame, least: int = 20) -> DataFrame:
    """Mean and std are null under ``least`` observations; the count stays."""
    enough = F.col("count") >= least
    return clim.withColumns({c: F.when(enough, F.col(c)) for c in ("mean", "std")})
