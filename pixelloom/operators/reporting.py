"""Seasonal statistics and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.functions.cases import CASES
from pixelloom.operators.screening import COUNTS, class_histogram, with_dominant

CELL = ("row", "col")


def persistence(screened: DataFrame, cell: Sequence[str] = CELL, case: str = "diagnostic_case") -> DataFrame:
    """Per pixel over all bins: counts by case, valid bins, and the actionable share (0 without valid bins)."""
    c = F.col(case)
    out = screened.groupBy(*cell).agg(
        F.count_if(c.isin(1, 2, 4, 5)).cast("int").alias("actionable_recurrence_count"),
        *(F.count_if(c == code).cast("int").alias(name) for code, name in ((1, "case_a_recurrence_count"), (2, "case_b_recurrence_count"), (4, "case_d_recurrence_count"), (5, "multi_recurrence_count"))),
        F.count_if(c != -1).cast("int").alias("valid_observation_count"),
    )
    share = F.when(F.col("valid_observation_count") > 0, F.col("actionable_recurrence_count") / F.col("valid_observation_count")).otherwise(0.0)
    return out.withColumn("actionable_recurrence_freq", share.cast("float"))


def require_same_cells(screened: DataFrame, cell: Sequence[str] = CELL) -> None:
    """A11's gate: at least one bin, and the same cells in each."""
    sizes = screened.groupBy("bin").agg(F.count_distinct(*cell).alias("n")).agg(F.min("n"), F.max("n")).first()
    if sizes[0] is None or sizes[0] != sizes[1]:
        raise ValueError("bins are missing or differ in their cells")


def hotspots(persisted: DataFrame, bounds: Sequence[int] = (1, 3, 6)) -> DataFrame:
    """Pixels with at least so many actionable bins, and their share."""
    n = F.count(F.lit(1))
    count = F.col("actionable_recurrence_count")
    return persisted.agg(n.alias("pixels"), *(x for b in bounds for x in (F.count_if(count >= b).alias(f"n_ge_{b}"), F.round(F.count_if(count >= b) / F.nullif(n, F.lit(0)) * 100, 2).alias(f"pct_ge_{b}"))))


def series_means(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("bin",)) -> DataFrame:
    """A10, R2: means over all cells of a bin."""
    return df.groupBy(*keys).agg(*(F.avg(v).alias(f"mean_{v}") for v in values))


def bin_summaries(screened: DataFrame, zones: DataFrame) -> DataFrame:
    """One row for each bin: its dates, zones, area, dominant case and class counts."""
    hist = with_dominant(class_histogram(screened, ("bin", "bin_start")))
    found = zones.groupBy("bin").agg(F.count(F.lit(1)).cast("int").alias("cluster_count"), (F.sum("area_m2") / 10_000).alias("total_area_ha"))
    out = hist.join(found, "bin", "left").na.fill(0, ["cluster_count"]).na.fill(0.0, ["total_area_ha"])
    return out.withColumn("bin_end", F.date_add("bin_start", 14)).withColumn("bin_index", (F.col("bin") + 1).cast("int"))


def season_summary(bins: DataFrame) -> DataFrame:
    """One row of totals.  bin_index is the position in the season, from 1; of bins
    with the largest area the first counts, and only areas over 0."""
    placed = bins.withColumn("position", F.row_number().over(Window.orderBy("bin_index")))  # a row for each bin
    busy = (F.col("cluster_count") > 0) | (F.col("total_area_ha") > 0)
    return placed.agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("cluster_count").alias("total_extracted_clusters"),
        F.round(F.sum("total_area_ha"), 2).alias("total_candidate_area_ha_cumulative"), F.count_if(busy).alias("actionable_bin_count"),
        F.min(F.when(busy, F.col("bin_start"))).alias("first_actionable_date"), F.max(F.when(busy, F.col("bin_start"))).alias("last_actionable_date"),
        F.round(F.max("total_area_ha"), 2).alias("max_single_bin_area_ha"),
        F.max_by(F.when(F.col("total_area_ha") > 0, F.col("position")), F.struct("total_area_ha", (-F.col("position")).alias("p"))).alias("max_area_bin_index"),
        *(F.sum(name).alias(name) for name in COUNTS.values()),
    )


def area_timeline(bins: DataFrame) -> DataFrame:
    """A bin's area split by its actionable pixels; without any, by the dominant case's name."""
    parts = {"case_a": 1, "case_b": 2, "case_d": 4, "multi": 5}
    all_px = sum((F.col(COUNTS[c]) for c in parts.values()), F.lit(0))
    area, name = F.col("total_area_ha"), F.coalesce("dominant_case", F.lit(""))
    named = {
        "case_a": F.lit(False),
        "case_b": name.contains("CASE_B"),
        "case_d": name.contains("CASE_D") & ~name.contains("CASE_B"),
        "multi": name.contains("MULTI") & ~name.contains("CASE_B") & ~name.contains("CASE_D"),
    }
    split = {f"{k}_area_ha": F.when((all_px > 0) & (area > 0), area * (F.col(COUNTS[c]) / F.nullif(all_px, F.lit(0)))).when((area > 0) & named[k], area).otherwise(0.0) for k, c in parts.items()}
    return bins.select("bin_index", "bin_start", *(v.alias(k) for k, v in split.items()))


def zone_markers(features: DataFrame, least_ha: float = 5.0) -> DataFrame:
    """The zones of a map with whether their centroid is marked."""
    return features.select("bin", "properties.zone_id", "properties.case_type", "properties.area_ha", "properties.centroid_lat", "properties.centroid_lon", (F.col("properties.area_ha") >= least_ha).alias("marked"))


#: Names of the class totals in the report.
TOTALS = {
    "normal_pixels": "normal", "case_a_pixels": "case_a_drought_stress", "case_b_pixels": "case_b_vegetation_anomaly_non_dry",
    "case_c_pixels": "case_c_drought_meteorological", "case_d_pixels": "case_d_hydrological_disconnect",
    "multi_signal_pixels": "multi_signal_overlap", "insufficient_evidence_pixels": "insufficient_evidence",
}


def summary_document(bins: DataFrame, aoi: dict, sources: dict[str, str]) -> dict:
    """A12 as a document.  Raises without bins; one row for each bin reaches the driver."""
    rows = [r.asDict() for r in bins.orderBy("bin_index").collect()]
    if not rows:
        raise ValueError("no bins")
    total = season_summary(bins).first().asDict()
    detail = [
        {"bin_index": k, "bin_start": str(r["bin_start"]), "cluster_count": r["cluster_count"], "area_ha": round(r["total_area_ha"], 2), "dominant_case": r["dominant_case"]}
        for k, r in enumerate(rows, 1)
        if r["cluster_count"] > 0 or r["total_area_ha"] > 0
    ]
    heads = ("total_extracted_clusters", "total_candidate_area_ha_cumulative", "actionable_bin_count", "first_actionable_date", "last_actionable_date", "max_single_bin_area_ha", "max_area_bin_index")
    return {
        "metadata": {"generated_utc": datetime.now(UTC).isoformat()},
        "spatial_scope": aoi,
        "temporal_scope": {"season_start": str(rows[0]["bin_start"]), "season_end": str(rows[-1]["bin_end"]), "n_canonical_bins": len(rows), "bin_interval_days": 14},
        "diagnostic_totals": {h: str(total[h]) if h.endswith("date") and total[h] else total[h] for h in heads},
        "pixel_classification_totals": {name: total[column] for column, name in TOTALS.items()},
        "actionable_bins_detail": detail,
        "provenance_and_sources": dict(sources),
    }


def write_json(document: dict, path: str) -> str:
    """K3."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return path


def markdown(document: dict) -> str:
    """K4: five sections; shares of a season without pixels are 0."""
    totals, classes = document["diagnostic_totals"], document["pixel_classification_totals"]
    season, everything = document["temporal_scope"], sum(classes.values())
    share = lambda n: f"{n / everything * 100 if everything else 0:.1f}%"
    out = [f"# Season {season['season_start']} to {season['season_end']}", "", "## 1. Headline", "", "| Indicator | Value |", "| :--- | ---: |"]
    out += [f"| {k.replace('_', ' ')} | {v} |" for k, v in totals.items()]
    out += ["", "## 2. Pixels by class", "", "| Class | Pixels | Share |", "| :--- | ---: | ---: |"]
    out += [f"| {k.replace('_', ' ')} | {v:,} | {share(v)} |" for k, v in classes.items()]
    out += ["", "## 3. Bins with zones", "", "| Bin | Start | Zones | Area (ha) | Dominant case |", "| ---: | :--- | ---: | ---: | :--- |"]
    out += [f"| {b['bin_index']} | {b['bin_start']} | {b['cluster_count']} | {b['area_ha']:.2f} | {b['dominant_case']} |" for b in document["actionable_bins_detail"]]
    out += ["", "## 4. Sources", "", *(f"- {k}: {v}" for k, v in document["provenance_and_sources"].items())]
    out += ["", "## 5. Limits", "", "- Zones are candidates for a visit, not confirmed damage.", "- Rainfall and soil moisture come from far coarser grids than the pixels.", f"- Cases: {', '.join(CASES.values())}.", ""]
    return "\n".join(out)


def write_markdown(document: dict, path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(markdown(document), encoding="utf-8")
    return path


#: What a bin's report says beside its counts.
REPORT_FACTS = {
    "pixel_area_source": "affine_transform", "mmu_threshold_m2": 20000.0, "connectivity": "8-connected",
    "area_calculation_crs": "EPSG:6933", "area_calculation_method": "pixel_count × pixel_area_m2 (projected)",
}


def file_name(bin_number: int, start: date) -> str:
    """K1: scouting_zones_bin_01_20230301.geojson."""
    return f"scouting_zones_bin_{bin_number + 1:02d}_{start:%Y%m%d}.geojson"


@contextmanager
def text_file(spark: SparkSession, path: str) -> Iterator[Callable[[str], None]]:
    """A function that appends text to the file at ``path``, in any file system that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    held: list[str] = []

    def flush() -> None:
        out.write(bytearray("".join(held).encode("utf-8")))
        held.clear()

    def write(text: str) -> None:
        held.append(text)
        if len(held) >= 256:
            flush()

    try:
        yield write
        flush()
    finally:
        out.close()


def _in_order(features: DataFrame, *columns: str) -> Iterator:
    """Features by bin and component, a partition at a time on the driver."""
    return features.select("bin", "comp_id", *columns).orderBy("bin", "comp_id").toLocalIterator()


def write_collections(features: DataFrame, report: DataFrame, starts: DataFrame, folder: str, grid_bbox: Sequence[float] | None = None, opened: bool = True) -> list[str]:
    """K1: a FeatureCollection file for each bin, those without zones too; returns the paths.

    starts: (bin, bin_start).  A row for each bin is held on the driver; features pass
    through it a partition at a time.
    """
    spark = features.sparkSession
    bins = {r["bin"]: r["bin_start"] for r in starts.select("bin", "bin_start").distinct().collect()}
    said = {r["bin"]: {k: v for k, v in r.asDict().items() if k != "bin"} for r in report.collect()}
    rows, paths = _in_order(features, "feature"), []
    row = next(rows, None)
    for number in sorted(bins):
        paths.append(f"{folder.rstrip('/')}/{file_name(number, bins[number])}")
        with text_file(spark, paths[-1]) as write:
            write('{"type": "FeatureCollection", "features": [')
            first = True
            while row is not None and row["bin"] <= number:
                if row["bin"] == number:
                    write(("\n" if first else ",\n") + row["feature"])
                    first = False
                row = next(rows, None)
            facts = said.get(number, {}) | REPORT_FACTS | {"morphology_applied": opened}
            tail = {"pipeline_report": facts} | ({"properties": {"grid_bbox": list(grid_bbox)}} if grid_bbox else {})
            write("],\n" + json.dumps(tail, ensure_ascii=False, default=str)[1:])
    return paths


def seasonal_collection(features: DataFrame) -> DataFrame:
    """K2: (bin, comp_id, feature) with bin_index as the last of the properties."""
    with_bin = F.concat(F.expr("substring(feature, 1, length(feature) - 2)"), F.lit(',"bin_index":'), (F.col("bin") + 1).cast("string"), F.lit("}}"))
    return features.select("bin", "comp_id", with_bin.alias("feature"))


def write_seasonal_collection(features: DataFrame, path: str, name: str, properties: Mapping[str, object]) -> str:
    """K2: all zones of a season in one FeatureCollection, in order of bin and component."""
    total = features.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("properties.area_ha"), 2).alias("ha")).first()
    facts = dict(properties) | {"total_features": total["n"], "cumulative_candidate_area_ha": total["ha"] or 0.0}
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}
    with text_file(features.sparkSession, path) as write:
        write('{"type": "FeatureCollection", "name": ' + json.dumps(name) + ', "crs": ' + json.dumps(crs) + ', "features": [')
        for k, row in enumerate(_in_order(seasonal_collection(features), "feature")):
            write((",\n" if k else "\n") + row["feature"])
        write('],\n"properties": ' + json.dumps(facts, ensure_ascii=False, default=str) + "}")
    return path


def manifest(document: dict | None = None, **paths: object) -> dict:
    """K6: what a run wrote, and when; with a summary document also its totals."""
    out: dict = {"status": "SUCCESS", "generated_utc": datetime.now(UTC).isoformat(), "exported_artifacts": paths}
    if document is not None:
        totals = document["diagnostic_totals"]
        out |= {
            "n_bins_executed": document["temporal_scope"]["n_canonical_bins"], "total_clusters": totals["total_extracted_clusters"],
            "cumulative_candidate_area_ha": totals["total_candidate_area_ha_cumulative"], "actionable_bin_count": totals["actionable_bin_count"], "summary": document,
        }
    return out
