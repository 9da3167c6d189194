"""Hand-computed cases of the operators over pixel-time tables."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pixelloom.errors import DataCompletenessError, GridAlignmentError, RangeError
from pixelloom.operators import anomaly, aoi, grid, hydrology, optical, reporting, screening, zones
from pixelloom.sources import gridded


def test_scl_mask_and_composite(spark):
    rows = []
    for k in range(6):
        for r in range(2):
            scl = 9 if k == 1 else (0 if k == 2 and r == 0 else 4)
            rows.append((datetime(2023, 4, 1) + timedelta(days=5 * k), r, 0, 1000 + k, scl))
    df = spark.createDataFrame(rows, "t timestamp, row int, col int, b04 int, scl int")
    masked = optical.scl_mask(df, ["b04"])
    got = {(x["bin"], x["row"]): x for x in optical.composite(masked, "b04").collect()}
    assert got[0, 0]["valid_obs_count"] == 1 and got[0, 1]["valid_obs_count"] == 2
    assert got[0, 1]["b04"] == 1001.0
    assert str(got[1, 0]["bin_start"]) == "2023-04-15"
    report = optical.quality_report(df, masked, optical.composite(masked, "b04"), "b04", "b04").first()
    assert report["scene_count"] == 6 and report["rejection_rate_scl"] == 25.0
    with pytest.raises(KeyError):
        optical.scl_mask(df.drop("scl"), ["b04"])


def test_composite_emits_empty_bins(spark):
    df = spark.createDataFrame([(datetime(2023, 3, 1), 0, 0, 1.0), (datetime(2023, 4, 20), 0, 0, 3.0)], "t timestamp, row int, col int, v double")
    got = sorted((r["bin"], r["v"], r["valid_obs_count"]) for r in optical.composite(df, "v").collect())
    assert got == [(0, 1.0, 1), (1, None, 0), (2, None, 0), (3, 3.0, 1)]


def test_smoothing_keeps_gaps(spark):
    df = spark.createDataFrame([(k, 0, 0, v) for k, v in enumerate([0.5, 0.6, None, 0.7, 0.8])], "bin int, row int, col int, v double")
    got = [r["smoothed"] for r in optical.smooth(df, "v").orderBy("bin").collect()]
    assert got[2] is None and [got[i] for i in (0, 1, 3, 4)] == pytest.approx([0.55, 0.55, 0.75, 0.75])


def test_crop_mask(spark):
    df = spark.createDataFrame([(r, c, 1.0) for r in range(2) for c in range(2)], "row int, col int, v double")
    mask = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, None)], "row int, col int, crop_mask double")
    got = {(r["row"], r["col"]): r["v"] for r in optical.crop_mask(df, mask, ["v"]).collect()}
    assert got == {(0, 0): 1.0, (0, 1): None, (1, 0): None, (1, 1): None}


def test_ndmi_and_alignment(spark):
    nir = spark.createDataFrame([(r, c, 0.5) for r in range(4) for c in range(4)], "row int, col int, b08 double")
    swir = spark.createDataFrame([(r, c, 0.2) for r in range(2) for c in range(2)], "row int, col int, b11 double")
    assert [r["ndmi"] for r in optical.ndmi(nir, swir, keys=()).collect()] == pytest.approx([0.4286] * 4, abs=1e-4)
    a = {"y0": 0, "y1": 10, "x0": 0, "x1": 10, "ny": 20, "nx": 20, "slope": 1.0, "crs": "EPSG:32736"}
    optical.require_alignment(a, a | {"ny": 10, "nx": 10})
    for bad in ({"x0": 100, "x1": 110}, {"ny": 20, "nx": 20}, {"crs": "EPSG:4326"}, {"slope": -1.0}):
        with pytest.raises(GridAlignmentError):
            optical.require_alignment(a, a | {"ny": 10, "nx": 10} | bad)


def test_bilinear(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 6.0)], "row int, col int, v double")
    target = spark.createDataFrame([(0.5, 0.5), (0.0, 0.5), (1.5, 0.0)], "row double, col double")
    got = {(r["row"], r["col"]): r["v"] for r in optical.bilinear(df, target, "v").collect()}
    assert got[0.5, 0.5] == 3.0 and got[0.0, 0.5] == 1.0 and got[1.5, 0.0] is None


def test_index_distribution(spark):
    df = spark.createDataFrame([(v,) for v in (0.2, 0.5, None, -1.5, 1.2, 0.8)], "v double")
    r = optical.index_distribution(df, "v").first()
    assert (r["total_pixels"], r["valid_pixels"], r["nan_pct"], r["min"], r["max"], r["out_of_bounds_count"], r["out_of_bounds_pct"]) == (6, 5, 16.67, -1.5, 1.2, 2, 40.0)
    empty = optical.index_distribution(df.where("v is null"), "v").first()
    assert empty["mean"] is None and empty["out_of_bounds_pct"] == 0.0


BINS = [date(2023, 3, 1), date(2023, 3, 15), date(2023, 3, 29)]


def test_half_open_bins(spark):
    def means(spikes):
        rows = [(datetime(2023, 3, 1) + timedelta(days=k), 0, 0, spikes.get(k + 1, 1.0)) for k in range(30)]
        df = spark.createDataFrame(rows, "t timestamp, lat_i int, lon_i int, s1 double")
        return [r["s1"] for r in hydrology.to_calendar(df, BINS[:2]).orderBy("bin").collect()]

    assert means({15: 99.0}) == pytest.approx([1.0, 8.0])
    assert means({29: 99.0}) == pytest.approx([1.0, 1.0])


def test_calendar_gate_and_empty_bins(spark):
    with pytest.raises(ValueError):
        hydrology.check_calendar([])
    with pytest.raises(ValueError):
        hydrology.check_calendar([BINS[0], BINS[2]])
    df = spark.createDataFrame([(datetime(2023, 3, 2), 0, 0, 0.5)], "t timestamp, lat_i int, lon_i int, s1 double")
    assert [r["s1"] for r in hydrology.to_calendar(df, BINS).orderBy("bin").collect()] == [0.5, None, None]


def test_change(spark):
    df = spark.createDataFrame([(k, 0, 0, v) for k, v in enumerate([0.50, 0.55, 0.45])], "bin int, lat_i int, lon_i int, s1 double")
    got = [r["delta_swi_14d"] for r in hydrology.change(df).orderBy("bin").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.05, -0.10])
    with pytest.raises(ValueError):
        hydrology.change(df.drop("s1"))


def months(first, last):
    y, m = first
    while (y, m) <= last:
        yield date(y, m, 1)
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)


def test_month_gate(spark):
    steps = [(d,) for d in months((1995, 1), (1997, 12))]
    df = spark.createDataFrame(steps, "t date")
    anomaly.require_months(df, "1995-01-01", "1997-12-01")
    anomaly.require_months(df, "1996-01-01", "1996-12-01")
    with pytest.raises(DataCompletenessError, match="missing: 1996-05"):
        anomaly.require_months(df.where("t <> date'1996-05-01'"), "1995-01-01", "1997-12-01")
    twice = df.unionByName(spark.createDataFrame([(date(1996, 5, 9),)], "t date"))
    with pytest.raises(DataCompletenessError, match="repeated: 1996-05"):
        anomaly.require_months(twice, "1995-01-01", "1997-12-01")
    rows = list(enumerate(steps))
    rows[3], rows[4] = (3, rows[4][1]), (4, rows[3][1])
    shuffled = spark.createDataFrame([(i, d[0]) for i, d in rows], "o int, t date")
    with pytest.raises(ValueError):
        gridded.require_monotonic(shuffled, "o")


def test_climatology_and_zscore(spark):
    import math

    rows = []
    for i, d in enumerate(months((1991, 1), (2000, 12))):
        rows += [(d, 0, 50.0), (d, 1, 50.0 + (1e-6 if i // 12 % 2 else -1e-6)), (d, 2, 50.0 + 10 * math.sin(i))]
    clim = anomaly.climatology(spark.createDataFrame(rows, "t date, cell int, rainfall double"), "rainfall", ["cell"])
    assert anomaly.invariant_count(clim).first()["invariant_pixel_count"] == 24
    target = spark.createDataFrame([(date(2023, 4, 1), c, 60.0) for c in range(3)], "t date, cell int, rainfall double")
    z = {r["cell"]: r["z"] for r in anomaly.zscore(target, clim, "rainfall", ["cell"]).collect()}
    assert z[0] is None and z[1] is None and math.isfinite(z[2])
    with pytest.raises(KeyError):
        anomaly.require_baseline(target, clim.where("month <> 4"))


def test_vegetation_baseline(spark):
    clim = spark.createDataFrame([(3, 0, 0.4, 0.1, 25), (4, 0, 0.5, 0.1, 25)], "month int, cell int, mean double, std double, count int")
    target = spark.createDataFrame([(date(2023, 3, 1), 0, 0.6), (date(2023, 3, 15), 0, 0.6), (date(2023, 4, 12), 0, 0.6)], "t date, cell int, ndvi double")
    got = [r["z"] for r in anomaly.zscore(target, anomaly.clim_qa(clim), "ndvi", ["cell"]).orderBy("t").collect()]
    assert got == pytest.approx([2.0, 2.0, 1.0])
    few = anomaly.clim_qa(clim.withColumn("count", F.lit(15)))
    assert {r["mean"] for r in few.collect()} == {None}
    one = anomaly.zscore(target, clim.where("month = 3").drop("month"), "ndvi", ["cell"], monthly=False)
    assert [r["z"] for r in one.collect()] == pytest.approx([2.0] * 3)


def regrid(spark, values, step, target):
    n = int(len(values) ** 0.5)
    rows = [((i + 0.5) * step, (j + 0.5) * step, values[i * n + j]) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "y double, x double, v double")
    return [r["v"] for r in grid.area_weighted(df, "v", 0.0, 0.0, target, target, 1, 1, step / 2, step / 2).collect()]


def test_area_weights(spark):
    assert regrid(spark, [1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0, 8.0, 9.0], 10.0, 30.0) == pytest.approx([5.0])
    assert regrid(spark, [None] * 9, 10.0, 30.0) == []
    assert regrid(spark, [0.2, 0.2, 0.6, 1.0] * 4, 25.0, 100.0) == pytest.approx([0.50])
    assert regrid(spark, [0.2, 0.2, None, 1.0] * 4, 25.0, 100.0) == pytest.approx([0.466667], abs=1e-6)


def test_nearest_lookup(spark):
    coarse = spark.createDataFrame([(i, j, float(i), float(j), 10.0 * i + j) for i in range(2) for j in range(2)], "lat_i int, lon_i int, lat double, lon double, v double")
    fine = spark.createDataFrame([(0, 0, 0.5, 0.4), (0, 1, 0.6, 9.0), (1, 0, -3.0, 0.5)], "row int, col int, lat double, lon double")
    got = {(r["row"], r["col"]): r["v"] for r in grid.assign_nearest(fine, coarse, ["v"]).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 11.0, (1, 0): 0.0}  # ties take the lower index


def test_canonical_grid(spark):
    box = (35.15, 0.55, 35.35, 0.75)
    df = grid.canonical_grid(spark, box)
    r = df.agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("row").alias("row"), F.max("col").alias("col"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("t")).first()
    assert (r["n"], r["x"], r["y"], r["row"], r["col"]) == (5590, 3400140.0, 81630.0, 85, 64)
    assert box[0] < r["w"] < r["e"] < box[2] and box[1] < r["s"] < r["t"] < box[3]


def block(r0, r1, c0, c1, b=0):
    return [(b, r, c) for r in range(r0, r1) for c in range(c0, c1)]


def cells(spark, rows):
    return spark.createDataFrame(rows, "bin bigint, row bigint, col bigint")


def test_opening(spark):
    assert zones.opening(cells(spark, [(0, 5, 5)])).count() == 0
    assert zones.opening(cells(spark, block(5, 15, 5, 15))).count() == 100
    assert zones.opening(cells(spark, block(0, 2, 0, 20))).count() == 0


def test_components_over_tiles(spark):
    rows = block(0, 3, 0, 3) + [(0, 3, 3), (0, 4, 4)] + block(0, 2, 8, 10) + [(0, 20, c) for c in range(12)] + block(0, 1, 0, 1, b=1)
    for tile in (4, 512):
        got = zones.label_components(cells(spark, rows), tile).collect()
        ids = {(r["bin"], r["row"], r["col"]): r["comp_id"] for r in got}
        assert len(ids) == len(set(rows))
        assert ids[0, 0, 0] == ids[0, 4, 4] == 1 and ids[0, 1, 9] == 2 and ids[0, 20, 0] == ids[0, 20, 11] == 3 and ids[1, 0, 0] == 1


def screened(spark, rows, case=1):
    return cells(spark, rows).select("bin", F.lit("2023-03-01").cast("date").alias("bin_start"), "row", "col", F.lit(case).cast("tinyint").alias("diagnostic_case"), F.lit(-1.5).alias("z_ndvi"), F.lit(None).cast("double").alias("z_r"), F.lit(0.1).alias("delta_swi_14d"), F.lit(1.0).alias("evidence_confidence"))


def test_mmu_and_features(spark):
    import json

    assert zones.scouting_zones(screened(spark, block(0, 3, 0, 3)), 0.0, 0.0)[0].count() == 0
    kept, report = zones.scouting_zones(screened(spark, block(0, 6, 0, 4)), 3400140.0, 81630.0)
    feature = json.loads(kept.first()["feature"])
    props = feature["properties"]
    assert props["zone_id"] == "SC-20230301-0001" and props["pixel_count"] == 24 and props["area_ha"] == 2.16 and props["area_ha_match"]
    assert props["case_type"] == "CASE_A" and props["mean_z_r"] is None and props["mean_z_ndvi"] == -1.5
    assert feature["geometry"]["type"] == "Polygon" and len(feature["geometry"]["coordinates"][0]) == 5
    r = report.first()
    assert (r["raw_actionable_pixels"], r["post_morphology_pixels"], r["n_surviving_clusters"], r["final_total_area_ha"]) == (24, 24, 1, 2.16)
    none = zones.scouting_zones(screened(spark, block(0, 6, 0, 4), case=0), 0.0, 0.0)
    assert none[0].count() == 0 and none[1].first()["raw_actionable_pixels"] == 0


def test_holes_and_corner_contacts(spark):
    ring = [x for x in block(0, 9, 0, 9) if not (3 <= x[1] < 6 and 3 <= x[2] < 6)]
    labels = zones.label_components(cells(spark, ring))
    shape = zones.zone_rings(zones.boundary_edges(labels)).first()["polygons"]
    assert len(shape) == 1 and len(shape[0]) == 2
    touching = block(0, 2, 0, 2) + block(2, 4, 2, 4)
    shape = zones.zone_rings(zones.boundary_edges(zones.label_components(cells(spark, touching)))).first()["polygons"]
    assert len(shape) == 2 and all(len(p) == 1 for p in shape)


def test_persistence_and_summary(spark):
    rows = [(b, r, c, (2 if (r, c) in {(4, 4), (4, 5), (5, 4), (5, 5)} else 0) if b == 0 else 0 if b == 1 else 4) for b in range(3) for r in range(10) for c in range(10)]
    df = spark.createDataFrame(rows, "bin bigint, row int, col int, diagnostic_case int")
    got = {(r["row"], r["col"]): r for r in reporting.persistence(df).collect()}
    assert got[4, 4]["actionable_recurrence_count"] == 2 and got[0, 0]["actionable_recurrence_count"] == 1
    assert got[4, 4]["actionable_recurrence_freq"] == pytest.approx(2 / 3) and got[0, 0]["actionable_recurrence_freq"] == pytest.approx(1 / 3)
    reporting.require_same_cells(df)
    with pytest.raises(ValueError):
        reporting.require_same_cells(df.where("not (bin = 1 and row = 0)"))
    blind = reporting.persistence(df.withColumn("diagnostic_case", F.lit(-1))).first()
    assert blind["actionable_recurrence_freq"] == 0.0


def bins(spark):
    rows = [(1, "2023-03-01", 22, 183.87, "CASE_B", 3000, 0, 2043, 0, 500, 47, 0), (2, "2023-03-15", 0, 0.0, "NORMAL", 5590, 0, 0, 0, 0, 0, 0), (10, "2023-07-05", 1, 503.10, "CASE_D", 0, 0, 0, 0, 5590, 0, 0)]
    names = ["bin_index", "bin_start", "cluster_count", "total_area_ha", "dominant_case", *screening.COUNTS.values()]
    df = spark.createDataFrame(rows, names).withColumn("bin_start", F.col("bin_start").cast("date"))
    return df.withColumn("bin_end", F.date_add("bin_start", 14))


def test_reports(spark, tmp_path):
    doc = reporting.summary_document(bins(spark), {"aoi_id": "a"}, {"soil": "x"})
    d = doc["diagnostic_totals"]
    assert (d["total_extracted_clusters"], d["total_candidate_area_ha_cumulative"], d["actionable_bin_count"], d["max_single_bin_area_ha"], d["max_area_bin_index"]) == (23, 686.97, 2, 503.1, 3)
    assert d["first_actionable_date"] == "2023-03-01" and d["last_actionable_date"] == "2023-07-05"
    assert reporting.write_json(doc, str(tmp_path / "x" / "s.json")) and reporting.write_markdown(doc, str(tmp_path / "s.md"))
    assert "## 5." in (tmp_path / "s.md").read_text()
    with pytest.raises(ValueError):
        reporting.summary_document(bins(spark).where("false"), {}, {})
    line = {r["bin_index"]: r for r in reporting.area_timeline(bins(spark)).collect()}
    assert line[10]["case_d_area_ha"] == pytest.approx(503.1) and line[2]["case_b_area_ha"] == 0.0


def test_dominant_ties(spark):
    names = list(screening.COUNTS.values())
    rows = [dict.fromkeys(names, 0) | x for x in ({"case_b_pixels": 3, "case_d_pixels": 3}, {"case_a_pixels": 2, "multi_signal_pixels": 2}, {"case_c_pixels": 9}, {"case_a_pixels": 1})]
    df = spark.createDataFrame([(i, *(r[n] for n in names)) for i, r in enumerate(rows)], ["i", *names])
    assert [r["dominant_case"] for r in screening.with_dominant(df).orderBy("i").collect()] == ["CASE_B", "MULTI_SIGNAL", "NORMAL", "CASE_A"]


def test_areas_of_interest(tmp_path):
    assert aoi.validate_bbox((35.0, 0.0, 36.0, 1.0)) == (35.0, 0.0, 36.0, 1.0)
    for bad in ((1, 2, 3), (10, 0, 5, 1), (0, 0, 190, 1), (0, 5, 1, 5)):
        with pytest.raises(ValueError):
            aoi.validate_bbox(bad)
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    poly = {"type": "Polygon", "coordinates": [ring]}
    whole = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": poly}]}
    assert aoi.rings_of(whole) == [ring]
    assert aoi.meets(poly, (1.9, 1.9, 3, 3)) and aoi.meets(poly, (2.04, 0, 3, 1)) and not aoi.meets(poly, (2.2, 2.2, 3, 3))
    for bad in ({"type": "Polygon", "coordinates": []}, {"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]]}, None):
        with pytest.raises(ValueError):
            aoi.rings_of(bad)
    (tmp_path / "a.geojson").write_text('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}')
    assert len(aoi.load_aoi(str(tmp_path / "a.geojson"))) == 1
    with pytest.raises(FileNotFoundError):
        aoi.load_aoi("no-such-file.geojson")
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert aoi.load_config(str(tmp_path / "c.json")) == {"a": 1}
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        aoi.load_config(str(tmp_path / "e.json"))


def test_figures_of_odd_tables(spark):
    from xml.etree import ElementTree

    from pixelloom.operators import figures

    for text in (figures.profile([]), figures.timeline([]), figures.heat_map([]), figures.zone_map([], (0, 0, 1, 1)), figures.profile([{"bin_start": "2023-03-01"}]), figures.profile([{"bin_start": "a<b", "mean_z_r": 1.0, "mean_swi": None}])):
        assert ElementTree.fromstring(text).tag.endswith("svg")
    big = spark.range(300 * 250).selectExpr("cast(id div 250 as int) + 7 as row", "cast(id % 250 as int) as col", "cast(id % 250 < 125 as int) as actionable_recurrence_count")
    blocks = figures.heat_blocks(big, 60).collect()
    assert max(r["row"] for r in blocks) <= 59 and min(r["row"] for r in blocks) == 0 and {r["value"] for r in blocks} == {0.0, 1.0}
