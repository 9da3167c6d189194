"""Masks, composites, smoothing and audits of optical series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.errors import GridAlignmentError
from pixelloom.functions.indices import normalised_difference
from pixelloom.operators.grid import onto_finer

CELL = ("row", "col")
VALID_SCL = (4, 5, 6)


def scl_mask(df: DataFrame, bands: Sequence[str], valid: Sequence[int] = VALID_SCL, scl: str = "scl") -> DataFrame:
    """P5: bands as 32-bit floats, null where the scene class is not valid; the class stays."""
    if scl not in df.columns:
        raise KeyError(scl)
    return df.withColumns({b: F.when(F.col(scl).isin(*valid), F.col(b).cast("float")) for b in bands})


def scl_mask_from_coarser(df: DataFrame, classes: DataFrame, bands: Sequence[str], valid: Sequence[int] = VALID_SCL, scl: str = "scl", keys: Sequence[str] = ("t",)) -> DataFrame:
    """As ``scl_mask`` with the scene classes of a coarser grid, (keys, y, x, scl): each cell has the class nearest to it."""
    return scl_mask(onto_finer(df, classes, [scl], keys), bands, valid, scl)


def crop_mask_from_coarser(df: DataFrame, mask: DataFrame, values: Sequence[str], wanted: float = 1, name: str = "crop_mask") -> DataFrame:
    """As ``crop_mask`` with a static mask on a coarser grid, (y, x, crop_mask)."""
    placed = onto_finer(df, mask, [name])
    return placed.withColumns({v: F.when(F.col(name) == wanted, F.col(v)) for v in values}).drop(name)


def crop_mask(df: DataFrame, mask: DataFrame, values: Sequence[str], wanted: float = 1, cell: Sequence[str] = CELL, name: str = "crop_mask") -> DataFrame:
    """Values are null where the static mask is another value, null or absent."""
    joined = df.join(mask.select(*cell, F.col(name).alias("_mask")), list(cell), "left")
    return joined.withColumns({v: F.when(F.col("_mask") == wanted, F.col(v)) for v in values}).drop("_mask")


def bin_of(day: Column, first: Column, days: int = 14) -> Column:
    """The number of the left-closed bin that a day falls into, counted from ``first``."""
    return F.floor(F.datediff(day, first) / days).cast("int")


def composite(df: DataFrame, value: str, days: int = 14, t: str = "t", cell: Sequence[str] = CELL) -> DataFrame:
    """A1: (bin, bin_start, cell, value, valid_obs_count): the exact median of each bin.

    Bins begin at the first observation's midnight; every cell has every bin up to the
    last, empty ones with a null median and a count of 0 (S5).  Rows are dealt by cell once;
    medians, the filling of gaps, and windows over a cell's bins need no other exchange.
    """
    span = df.agg(F.to_date(F.min(t)).alias("first"), F.to_date(F.max(t)).alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    dealt = df.select(*cell, bin_of(F.to_date(t), first, days).alias("bin"), value).repartition(*cell)
    seen = dealt.groupBy(*cell, "bin").agg(F.median(value).alias(value), F.count(value).cast("int").alias("n"))
    by_cell = seen.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct(value, "n")))).alias("of"))  # a cell's bins
    dense = by_cell.select(*cell, "of", F.explode(F.sequence(F.lit(0), bin_of(last, first, days))).alias("bin")).withColumn("of", F.element_at("of", F.col("bin")))
    return dense.select("bin", F.date_add(first, F.col("bin") * days).alias("bin_start"), *cell, F.col(f"of.{value}").alias(value), F.coalesce("of.n", F.lit(0)).alias("valid_obs_count"))


def smooth(df: DataFrame, value: str, window: int = 3, min_periods: int = 1, cell: Sequence[str] = CELL, order: str = "bin", out: str = "smoothed") -> DataFrame:
    """Centred mean over bins without nulls; a null stays null."""
    over = Window.partitionBy(*cell).orderBy(order).rowsBetween(-(window // 2), window - 1 - window // 2)
    return df.withColumn(out, F.when(F.col(value).isNotNull() & (F.count(value).over(over) >= min_periods), F.avg(value).over(over)))


def clear_share(raw: DataFrame, masked: DataFrame, band: str, t: str = "t") -> DataFrame:
    """A5, by date: (t, raw_valid, retained, clear_pct)."""
    def count(df, name):
        return df.groupBy(t).agg(F.count(band).alias(name))

    both = count(raw, "raw_valid").join(count(masked, "retained"), t)
    share = F.when(F.col("raw_valid") > 0, F.col("retained") / F.col("raw_valid") * 100).otherwise(0.0)
    return both.withColumn("clear_pct", F.round(share, 2))


def quality_report(raw: DataFrame, masked: DataFrame, composed: DataFrame, band: str, value: str, t: str = "t") -> DataFrame:
    """A5: one row with scene_count, rejection_rate_scl, mean_valid_obs_per_bin, unfilled_bins_pct."""
    days = clear_share(raw, masked, band, t).agg(F.count(F.lit(1)).alias("scene_count"), F.sum("raw_valid").alias("r"), F.sum("retained").alias("m"))
    bins = composed.agg(F.avg("valid_obs_count").alias("obs"), F.count(F.lit(1)).alias("cells"), F.count(value).alias("filled"))
    one = days.withColumn("one", F.lit(1)).join(bins.withColumn("one", F.lit(1)), "one")
    lost = F.when(F.col("r") > 0, (F.col("r") - F.col("m")) / F.col("r") * 100).otherwise(0.0)
    empty = F.when(F.col("cells") > 0, (F.col("cells") - F.col("filled")) / F.col("cells") * 100).otherwise(0.0)
    return one.select("scene_count", F.round(lost, 2).alias("rejection_rate_scl"), F.round(F.coalesce("obs", F.lit(0.0)), 2).alias("mean_valid_obs_per_bin"), F.round(empty, 2).alias("unfilled_bins_pct"))


def index_distribution(df: DataFrame, value: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """One row; statistics are null if every value is."""
    v = F.col(value)
    out = df.agg(
        F.count(F.lit(1)).alias("total_pixels"), F.count(v).alias("valid_pixels"), F.count_if(v.isNull()).alias("nan_pixels"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.count_if((v < low) | (v > high)).alias("out_of_bounds_count"),
    )
    nan_pct = F.when(F.col("total_pixels") > 0, F.col("nan_pixels") / F.col("total_pixels") * 100).otherwise(0.0)
    oob_pct = F.when(F.col("valid_pixels") > 0, F.col("out_of_bounds_count") / F.col("valid_pixels") * 100).otherwise(0.0)
    return out.select("total_pixels", "valid_pixels", "nan_pixels", F.round(nan_pct, 2).alias("nan_pct"), *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")), "out_of_bounds_count", F.round(oob_pct, 2).alias("out_of_bounds_pct"))


def block_mean(df: DataFrame, value: str, keys: Sequence[str] = (), factor: int = 2, row: str = "row", col: str = "col") -> DataFrame:
    """G1: the mean of the known values of factor x factor cells, on the coarser ordinals."""
    return df.groupBy(*keys, F.floor(F.col(row) / factor).cast("int").alias(row), F.floor(F.col(col) / factor).cast("int").alias(col)).agg(F.avg(value).alias(value))


def ndmi(nir: DataFrame, swir: DataFrame, nir_name: str = "b08", swir_name: str = "b11", keys: Sequence[str] = ("t",)) -> DataFrame:
    """M3: near infrared at half the step, averaged to the short-wave grid; then the normalised difference."""
    both = block_mean(nir, nir_name, keys).join(swir.select(*keys, *CELL, swir_name), [*keys, *CELL])
    return both.withColumn("ndmi", normalised_difference(F.col(nir_name), F.col(swir_name)))


def bilinear(df: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """Values at fractional (row, col) of ``target`` from the four cells around them; null unless all that weigh are known."""
    r, c = F.floor("row").cast("int"), F.floor("col").cast("int")
    corners = F.array(*(F.struct((r + i).alias("r"), (c + j).alias("c"), ((1 - F.abs(F.col("row") - (r + i))) * (1 - F.abs(F.col("col") - (c + j)))).alias("w")) for i in (0, 1) for j in (0, 1)))
    want = target.select(target["row"], target["col"], F.explode(corners).alias("k")).where("k.w > 0")
    have = df.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).cast("double").alias("v"))
    met = want.select("row", "col", F.col("k.r").alias("r"), F.col("k.c").alias("c"), F.col("k.w").alias("w")).join(have, ["r", "c"], "left")
    return met.groupBy("row", "col").agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum(F.col("w") * F.col("v"))).alias(value))


def grid_facts(df: DataFrame, crs: str | None = None, y: str = "y", x: str = "x") -> dict:
    """Extent, size and orientation of a grid: one aggregate."""
    row = df.agg(F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.count_distinct(y).alias("ny"), F.count_distinct(x).alias("nx"), F.corr("row", y).alias("slope")).first().asDict()
    return row | {"crs": crs}


def require_alignment(fine: dict, coarse: dict, low: float = 1.4, high: float = 2.6) -> None:
    """M4: equal CRS if both are known, overlap of positive extent, one orientation, size ratios within bounds."""
    if fine["crs"] and coarse["crs"] and fine["crs"] != coarse["crs"]:
        raise GridAlignmentError(f"{fine['crs']} and {coarse['crs']}")
    for a in ("y", "x"):
        if min(fine[f"{a}1"], coarse[f"{a}1"]) <= max(fine[f"{a}0"], coarse[f"{a}0"]):
            raise GridAlignmentError(f"no overlap along {a}")
        ratio = fine[f"n{a}"] / coarse[f"n{a}"]
        if not low <= ratio <= high:
            raise GridAlignmentError(f"size ratio {ratio:.2f} along {a}")
    if (fine["slope"] or 0) * (coarse["slope"] or 0) < 0:
        raise GridAlignmentError("rows run in opposite directions")
