"""Grids: the canonical one, nearest cells, area weights, nearest months."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.functions.projection import cea_lat, cea_lon, cea_point


def canonical_origin(bbox: Sequence[float], step: float = 30.0, rows: int = 86, cols: int = 65) -> tuple[float, float]:
    """The grid's first x and y: centred on the box, snapped down to the step."""
    x0, y0 = cea_point(bbox[0], bbox[1])
    x1, y1 = cea_point(bbox[2], bbox[3])
    return tuple(math.floor(((a + b) / 2 - n * step / 2) / step) * step for a, b, n in ((x0, x1, cols), (y0, y1, rows)))


def canonical_grid(spark: SparkSession, bbox: Sequence[float], step: float = 30.0, rows: int = 86, cols: int = 65) -> DataFrame:
    """(row, col, y, x, lat, lon) of every cell; row 0 is the southernmost."""
    x0, y0 = canonical_origin(bbox, step, rows, cols)
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    cells = cells.select("row", "col", (F.lit(y0) + F.col("row") * step).alias("y"), (F.lit(x0) + F.col("col") * step).alias("x"))
    return cells.select("row", "col", "y", "x", cea_lat(F.col("y")).alias("lat"), cea_lon(F.col("x")).alias("lon"))


def nearest_on_axis(fine: DataFrame, coarse: DataFrame, at: str, index: str) -> DataFrame:
    """(at, index): the coarse coordinate nearest to each fine one, on a tie the lowest index.

    fine: (at); coarse: (at, index).  Both are one axis of a grid, so they are small; one
    sort finds the neighbours on either side, and no pair is formed.
    """
    known = coarse.groupBy(at).agg(F.min(index).alias(index))
    both = known.select(F.col(at).cast("double").alias("p"), F.col(index).alias("i"), F.lit(0).alias("own")).unionByName(fine.select(F.col(at).cast("double").alias("p"), F.lit(None).cast(known.schema[index].dataType).alias("i"), F.lit(1).alias("own")).distinct())
    mark = F.when(F.col("own") == 0, F.struct("p", "i"))
    up = Window.orderBy("p", "own")
    below = F.last(mark, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(mark, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    found = both.select("p", "own", below.alias("b"), above.alias("a")).where("own = 1")
    db, da = F.col("p") - F.col("b.p"), F.col("a.p") - F.col("p")
    pick = F.when(F.col("a").isNull(), F.col("b.i")).when(F.col("b").isNull(), F.col("a.i")).when(db < da, F.col("b.i")).when(da < db, F.col("a.i")).otherwise(F.least("a.i", "b.i"))
    return found.select(F.col("p").alias(at), pick.alias(index))


def assign_nearest(fine: DataFrame, coarse: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Values of the coarse cell nearest in latitude and, on its own, in longitude.

    fine: (row, col, lat, lon); coarse: (keys, lat_i, lon_i, lat, lon, values).  Looked up,
    never interpolated; values become 32-bit floats.
    """
    lat = nearest_on_axis(fine.select("lat"), coarse.select("lat", "lat_i").distinct(), "lat", "lat_i")
    lon = nearest_on_axis(fine.select("lon"), coarse.select("lon", "lon_i").distinct(), "lon", "lon_i")
    placed = fine.join(lat, "lat").join(lon, "lon")
    return placed.join(coarse.select(*keys, "lat_i", "lon_i", *(F.col(v).cast("float").alias(v) for v in values)), ["lat_i", "lon_i"])


def onto_finer(fine: DataFrame, coarse: DataFrame, values: Sequence[str], keys: Sequence[str] = (), axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """``fine`` with the values of the coarse cell nearest along each axis, on a tie the
    lower coordinate; null where the coarse grid has no such cell.  Columns of ``fine`` with
    the values' names are replaced."""
    out = fine.drop(*values)
    kept = out.columns
    for k, axis in enumerate(axes):
        near = nearest_on_axis(fine.select(axis), coarse.select(axis, F.col(axis).alias("_at")), axis, "_at")
        out = out.join(near.select(F.col(axis).alias(f"_axis{k}"), F.col("_at").alias(f"_near{k}")), F.col(axis).cast("double") == F.col(f"_axis{k}"), "left")
    there = coarse.select(*(F.col(c).alias(f"_key_{c}") for c in keys), *(F.col(axis).alias(f"_there{k}") for k, axis in enumerate(axes)), *(F.col(v).alias(f"_value_{v}") for v in values))
    same = [F.col(c) == F.col(f"_key_{c}") for c in keys] + [F.col(f"_near{k}") == F.col(f"_there{k}") for k in range(len(axes))]
    return out.join(there, same, "left").select(*kept, *(F.col(f"_value_{v}").alias(v) for v in values))


def nearest_month(targets: DataFrame, steps: DataFrame, t: str = "t", month: str = "month_start") -> DataFrame:
    """(t, month_start): the monthly step nearest to each time in days, either way; the earlier on a tie."""
    days = steps.select(F.datediff(F.col(month), F.lit("1970-01-01")).alias("d")).distinct().select("d", F.col("d").alias("i"))
    want = targets.select(t).distinct().withColumn("d", F.datediff(F.col(t), F.lit("1970-01-01")))
    found = nearest_on_axis(want.select("d"), days, "d", "i")
    return want.join(found, want["d"] == found["d"]).select(t, F.date_add(F.lit("1970-01-01").cast("date"), F.col("i").cast("int")).alias(month))


def area_weighted(src: DataFrame, value: str, x0: float, y0: float, step_x: float, step_y: float, rows: int, cols: int, half_x: Column | float, half_y: Column | float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, row, col, value) on a regular grid: means weighted by overlap over known values.

    src: cell centres x and y in the target's projection, half_x and half_y half their
    size; (x0, y0) is the outer corner of the target's cell (0, 0), steps may be negative.
    A cell that no known value overlaps is null.
    """
    hx, hy = (h if isinstance(h, Column) else F.lit(float(h)) for h in (half_x, half_y))

    def span(c: str, h: Column, origin: float, step: float, n: int, name: str) -> Column:
        a, b = (F.col(c) - h - origin) / step, (F.col(c) + h - origin) / step
        low, high = F.least(a, b), F.greatest(a, b)
        first, last = F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.ceil(high) - 1, F.lit(n - 1)).cast("int")
        hits = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(hits, lambda k: F.struct(k.alias(name), (F.least(high, k + 1.0) - F.greatest(low, k.cast("double"))).alias(f"w_{name}")))

    there = src.where(F.col(value).isNotNull())
    rowed = there.select(*keys, "x", value, F.explode(span("y", hy, y0, step_y, rows, "row")).alias("r"))
    both = rowed.select(*keys, value, "r", F.explode(span("x", hx, x0, step_x, cols, "col")).alias("c"))
    w = F.col("r.w_row") * F.col("c.w_col")
    out = both.groupBy(*keys, F.col("r.row").alias("row"), F.col("c.col").alias("col")).agg(F.sum(w * F.col(value)).alias("s"), F.sum(w).alias("w"))
    return out.select(*keys, "row", "col", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias(value))
