"""The seasonal screening run: one plan over all bins, no loop."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import anomaly, figures, grid, hydrology, reporting, screening, zones
from pixelloom.session import materialize


@dataclass
class Season:
    """What a run gives: tables by bin, by zone and by pixel."""

    screened: DataFrame
    features: DataFrame
    report: DataFrame
    bins: DataFrame
    persisted: DataFrame
    timeline: DataFrame


def run(soil: DataFrame, baseline: DataFrame, rain: DataFrame, ndvi: DataFrame, ndvi_clim: DataFrame, cells: DataFrame, bins: Sequence[date], origin: tuple[float, float], step: float = 30.0, baseline_span: tuple[str, str] | None = None, opened: bool = True) -> Season:
    """Screen a season.

    soil: (t, lat_i, lon_i, lat, lon, s1); baseline and rain: (t, lat_i, lon_i, lat, lon,
    rainfall) by month; ndvi: (bin, bin_start, row, col, ndvi); ndvi_clim: (month, row,
    col, mean, std, count); cells: (row, col, lat, lon); origin: centre of cell (0, 0).
    """
    if baseline_span:
        anomaly.require_months(baseline, *baseline_span)
    soil_keys = ("lat_i", "lon_i", "lat", "lon")
    wet = hydrology.change(hydrology.to_calendar(hydrology.daily_mean(soil, cell=soil_keys).withColumnRenamed("day", "t"), bins, cell=soil_keys), cell=soil_keys)
    clim = anomaly.climatology(baseline, "rainfall", ("lat_i", "lon_i"))
    anomaly.require_baseline(rain, clim)
    z_r = anomaly.zscore(rain, clim, "rainfall", ("lat_i", "lon_i"), out="z_r")
    z_ndvi = anomaly.zscore(ndvi, anomaly.clim_qa(ndvi_clim), "ndvi", ("row", "col"), t="bin_start", out="z_ndvi")

    starts = wet.select("bin", "bin_start").distinct()
    # the month of the bin's first day, or the nearest one there is
    own = starts.withColumn("month", F.trunc("bin_start", "month"))
    months = grid.nearest_month(own.select(F.col("month").alias("t")), rain.select(F.trunc("t", "month").alias("month_start")))
    monthly = own.join(months, own["month"] == months["t"]).select("bin", "month_start")
    rain_bins = z_r.withColumn("month_start", F.trunc("t", "month")).join(monthly, "month_start").select("bin", "lat_i", "lon_i", "lat", "lon", "z_r")

    wet_fine = grid.assign_nearest(cells, wet, ("s1", "delta_swi_14d"), ("bin",)).select("bin", "row", "col", F.col("s1").alias("swi"), "delta_swi_14d")
    rain_fine = grid.assign_nearest(cells, rain_bins, ("z_r",), ("bin",)).select("bin", "row", "col", "z_r")
    joined = z_ndvi.select("bin", "row", "col", "z_ndvi").join(wet_fine, ["bin", "row", "col"], "full").join(rain_fine, ["bin", "row", "col"], "full").join(starts, "bin")
    screened = materialize(screening.screen(joined), "screened")
    features, report = zones.scouting_zones(screened, *origin, step, opened)
    features = materialize(features, "features")
    areas = features.select("bin", (F.col("properties.pixel_count") * F.lit(step * step)).alias("area_m2"))
    summary = reporting.bin_summaries(screened, areas)
    return Season(screened, features, report, summary, reporting.persistence(screened), reporting.area_timeline(summary))


def export(season: Season, folder: str, scope: dict, sources: dict[str, str], grid_bbox: Sequence[float] | None = None, year: str = "", opened: bool = True) -> dict:
    """Write a run's files and return their manifest (K1-K6).

    ``folder``/geojson gets a collection for each bin and one for the season, ``folder``/reports
    the summary as JSON and Markdown, ``folder``/figures the figures, a map for each bin with
    zones.  scope: the area of interest, with aoi_id and aoi_name.
    """
    spark, tail = season.screened.sparkSession, f"_{year}" if year else ""
    document = reporting.summary_document(season.bins, scope, sources)
    bins = reporting.write_collections(season.features, season.report, season.bins, f"{folder}/geojson", grid_bbox, opened)
    properties = {k: scope[k] for k in ("aoi_id", "aoi_name", "season") if k in scope} | ({"grid_bbox": list(grid_bbox)} if grid_bbox else {}) | sources
    whole = reporting.write_seasonal_collection(season.features, f"{folder}/geojson/seasonal_scouting_zones{tail}.geojson", f"seasonal_scouting_zones_{scope.get('aoi_id', 'area')}{tail}", properties)
    texts = {"summary_json": json.dumps(document, indent=2, ensure_ascii=False, default=str), "summary_markdown": reporting.markdown(document)}
    paths = {name: f"{folder}/reports/seasonal_executive_summary{tail}.{end}" for name, end in (("summary_json", "json"), ("summary_markdown", "md"))}
    for name, path in paths.items():
        with reporting.text_file(spark, path) as write:
            write(texts[name])
    drawn = _draw(season, f"{folder}/figures", tail, grid_bbox)
    return reporting.manifest(document, **paths, seasonal_geojson=whole, bin_geojson=bins, **drawn)


def _draw(season: Season, folder: str, tail: str, bbox: Sequence[float] | None) -> dict[str, object]:
    """The figures' paths.  A row for each bin, a bounded heat map and one bin's zones at a time are held."""
    spark = season.screened.sparkSession
    means = reporting.series_means(season.screened, ("z_r", "z_ndvi", "swi", "delta_swi_14d"), ("bin", "bin_start")).orderBy("bin")
    texts = {
        "temporal_profile_plot": (f"temporal_diagnostic_profile{tail}.svg", figures.profile([r.asDict() for r in means.collect()])),
        "area_timeline_plot": (f"diagnostic_area_timeline{tail}.svg", figures.timeline([r.asDict() for r in season.timeline.orderBy("bin_index").collect()])),
        "persistence_heatmap_plot": (f"spatial_persistence_hotspots{tail}.svg", figures.heat_map([r.asDict() for r in figures.heat_blocks(season.persisted).collect()])),
    }
    out: dict[str, object] = {}
    for name, (file, text) in texts.items():
        out[name] = f"{folder}/{file}"
        with reporting.text_file(spark, out[name]) as write:
            write(text)
    maps = []
    for row in season.features.groupBy("bin", "bin_start").count().orderBy("bin").collect() if bbox else []:
        maps.append(f"{folder}/spatial_diagnostic_bin_{row['bin'] + 1:02d}.svg")
        zones_of = [r["feature"] for r in season.features.where(F.col("bin") == row["bin"]).select("comp_id", "feature").orderBy("comp_id").toLocalIterator()]
        with reporting.text_file(spark, maps[-1]) as write:
            write(figures.zone_map(zones_of, bbox, f"Zones from {row['bin_start']}"))
    return out | {"spatial_maps": maps}
