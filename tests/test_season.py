"""A whole season on made-up inputs, against the totals that are known for it."""

import json
import xml.etree.ElementTree as ElementTree
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from pixelloom.operators import grid, reporting
from pixelloom.plans import season
from pixelloom.sources import gridded

#: The area, the first bin, and the totals of the season.
AREA = (35.15, 0.55, 35.35, 0.75)
FIRST, BINS = date(2023, 3, 1), 15
TOTALS = {
    "total_extracted_clusters": 28, "total_candidate_area_ha_cumulative": 3202.47, "actionable_bin_count": 7, "first_actionable_date": "2023-03-01",
    "last_actionable_date": "2023-09-13", "max_single_bin_area_ha": 503.1, "max_area_bin_index": 10,
}
CLASSES = {
    "normal": 43926, "case_a_drought_stress": 0, "case_b_vegetation_anomaly_non_dry": 6384, "case_c_drought_meteorological": 0,
    "case_d_hydrological_disconnect": 27137, "multi_signal_overlap": 6403, "insufficient_evidence": 0,
}


def table(values, times, lats, lons, name, time="t"):
    t, i, j = np.meshgrid(np.arange(len(times)), np.arange(len(lats)), np.arange(len(lons)), indexing="ij")
    return pd.DataFrame({time: np.asarray(times)[t.ravel()], "lat_i": i.ravel(), "lon_i": j.ravel(), "lat": lats[i.ravel()], "lon": lons[j.ravel()], name: values.astype(np.float64).ravel()})


def inputs():
    """Draws from one generator in a fixed order: soil, rainfall of the baseline and of the year, vegetation bin by bin."""
    rng = np.random.RandomState(42)
    steps = pd.date_range("2023-03-01", "2023-09-30 21:00", freq="3h")
    lats, lons = np.arange(0.50, 0.82, 0.08), np.arange(35.10, 35.42, 0.08)
    wave = 0.30 + 0.25 * np.sin(np.linspace(0, np.pi, len(steps)))
    noise = rng.normal(0, 0.05, size=(len(steps), len(lats), len(lons)))
    soil = table(np.clip(wave[:, None, None] + noise, 0.10, 0.85).astype(np.float32), steps, lats, lons, "sm_rootzone_wetness", "time")
    lats, lons = np.arange(0.55, 0.76, 0.05), np.arange(35.15, 35.36, 0.05)
    years, year = pd.date_range("1991-01-01", "2020-12-01", freq="MS"), pd.date_range("2023-03-01", "2023-09-01", freq="MS")
    base = table(rng.uniform(30.0, 180.0, size=(len(years), len(lats), len(lons))).astype(np.float32), years, lats, lons, "rainfall")
    rain = table(rng.uniform(90.0, 220.0, size=(len(year), len(lats), len(lons))).astype(np.float32), year, lats, lons, "rainfall")
    rows, cols = np.divmod(np.arange(86 * 65), 65)
    ndvi = [pd.DataFrame({"bin": k, "row": rows, "col": cols, "ndvi": (0.35 + 0.35 * np.sin((k + 2) / 18.0 * np.pi) + rng.normal(0, 0.04, size=(86, 65)).astype(np.float32)).astype(float).ravel()}) for k in range(BINS)]
    return soil, base, rain, pd.concat(ndvi)


@pytest.fixture(scope="module")
def run(spark):
    soil, base, rain, ndvi = inputs()
    days = [FIRST + timedelta(days=14 * k) for k in range(BINS)]
    starts = spark.createDataFrame(list(enumerate(days)), "bin int, bin_start date")
    raw = spark.createDataFrame(soil)
    wet = gridded.load_soil_subdaily(spark, raw, AREA, "2023-03-01", "2023-09-30").join(raw.select("lat", "lon", "lat_i", "lon_i").distinct(), ["lat", "lon"])
    cells = grid.canonical_grid(spark, AREA)
    clim = cells.selectExpr("row", "col", "explode(sequence(1, 12)) as month", "0.6D as mean", "0.08D as std", "100L as count")
    optical = spark.createDataFrame(ndvi).join(starts, "bin")
    return season.run(wet, spark.createDataFrame(base), spark.createDataFrame(rain), optical, clim, cells, days, grid.canonical_origin(AREA), baseline_span=("1991-01-01", "2020-12-01"))


def test_totals_of_the_season(run):
    document = reporting.summary_document(run.bins, {"aoi_id": "a"}, {})
    assert document["diagnostic_totals"] == TOTALS
    assert document["pixel_classification_totals"] == CLASSES
    report = {r["bin"]: r for r in run.report.collect()}
    assert (report[1]["raw_actionable_pixels"], report[1]["post_morphology_pixels"]) == (1701, 0)
    zone = json.loads(run.features.where("bin = 14").first()["feature"])["properties"]
    assert (zone["pixel_count"], zone["area_ha"], zone["centroid_lon"], zone["centroid_lat"]) == (5590, 503.1, 35.249571, 0.649875)
    marks = reporting.zone_markers(run.features).collect()
    assert len(marks) == 28 and all(m["marked"] == (m["area_ha"] >= 5) for m in marks) and any(m["marked"] for m in marks)


def test_files_of_the_season(run, tmp_path):
    box = (35.1, 0.6, 35.3, 0.7)
    said = season.export(run, str(tmp_path), {"aoi_id": "a", "aoi_name": "Área", "season": "s"}, {"soil": "x"}, box, "2023")
    assert said["n_bins_executed"] == 15 and said["total_clusters"] == 28 and said["cumulative_candidate_area_ha"] == 3202.47 and said["status"] == "SUCCESS"
    files = sorted(p.name for p in (tmp_path / "geojson").glob("*.geojson"))
    assert len(files) == 16 and files[0] == "scouting_zones_bin_01_20230301.geojson" and files[-1] == "seasonal_scouting_zones_2023.geojson"
    found = 0
    for name in files[:-1]:
        one = json.loads((tmp_path / "geojson" / name).read_text(encoding="utf-8"))
        assert one["type"] == "FeatureCollection" and one["properties"]["grid_bbox"] == list(box)
        assert one["pipeline_report"]["n_surviving_clusters"] == len(one["features"]) and one["pipeline_report"]["morphology_applied"]
        assert all("bin_index" not in f["properties"] for f in one["features"])
        found += len(one["features"])
    second = json.loads((tmp_path / "geojson" / files[1]).read_text())["pipeline_report"]
    assert (second["raw_actionable_pixels"], second["raw_actionable_area_ha"], second["post_morphology_area_ha"], second["pixel_area_m2"]) == (1701, 153.09, 0.0, 900.0)
    whole = json.loads((tmp_path / "geojson" / files[-1]).read_text(encoding="utf-8"))
    assert found == len(whole["features"]) == whole["properties"]["total_features"] == 28
    order = [(f["properties"]["bin_index"], f["properties"]["zone_id"]) for f in whole["features"]]
    assert order == sorted(order) and whole["properties"]["cumulative_candidate_area_ha"] == 3202.47 and whole["properties"]["aoi_name"] == "Área"
    drawn = sorted(p.name for p in (tmp_path / "figures").glob("*.svg"))
    assert len(drawn) == 10 and all((tmp_path / "figures" / n).stat().st_size > 1500 for n in drawn)
    trees = {n: ElementTree.parse(tmp_path / "figures" / n).getroot() for n in drawn}
    assert {t.tag for t in trees.values()} == {"{http://www.w3.org/2000/svg}svg"} and len(said["exported_artifacts"]["spatial_maps"]) == 7
    tag = lambda name, t: trees[name].findall(".//{http://www.w3.org/2000/svg}" + t)
    assert len(tag("spatial_diagnostic_bin_01.svg", "path")) == 22
    assert len(tag("spatial_persistence_hotspots_2023.svg", "rect")) > 5590
    report = json.loads((tmp_path / "reports" / "seasonal_executive_summary_2023.json").read_text())
    assert report["diagnostic_totals"] == TOTALS and "## 5." in (tmp_path / "reports" / "seasonal_executive_summary_2023.md").read_text()
