"""Hand-computed cases of indices, classification and projections."""

import math

import pytest
from pyspark.sql import functions as F

from pixelloom.functions import cases, indices, projection


def value(spark, column, schema="x int", rows=((1,),)):
    return spark.createDataFrame(list(rows), schema).select(column.alias("v")).first()["v"]


def test_ndvi_and_scale(spark):
    df = spark.createDataFrame([(1000, 5000), (2000, 2000)], "red int, nir int")
    got = [r[0] for r in df.select(indices.ndvi(indices.reflectance(df, "red"), indices.reflectance(df, "nir"))).collect()]
    assert got == pytest.approx([0.6667, 0.0], abs=1e-4)


def test_evi(spark):
    df = spark.createDataFrame([(0.04, 0.08, 0.40)], "b double, r double, n double")
    assert df.select(indices.evi(F.col("b"), F.col("r"), F.col("n"))).first()[0] == pytest.approx(0.5063, abs=1e-4)
    zero = spark.createDataFrame([(0.4, 0.0, 2.0), (None, 0.0, 2.0)], "b double, r double, n double")
    got = [r[0] for r in zero.select(indices.evi(F.col("b"), F.col("r"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(2.5 * 2.0 / 1e-6) or math.isfinite(got[0])
    assert got[1] is None


def test_marked_floats_scale_by_their_maximum(spark):
    df = spark.createDataFrame([(5000.0,), (1.0,)], "b double")
    assert [r[0] for r in df.select(indices.reflectance(df, "b", has_scale=True)).collect()] == pytest.approx([0.5, 0.0001])
    low = spark.createDataFrame([(0.5,)], "b double")
    assert low.select(indices.reflectance(low, "b", has_scale=True)).first()[0] == 0.5


def test_standardised_guards_its_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1e-4), (1.0, 0.0, 0.0), (1.0, 0.5, 0.25), (None, 0.5, 0.25)], "x double, m double, s double")
    assert [r[0] for r in df.select(indices.standardised(F.col("x"), F.col("m"), F.col("s"))).collect()] == [None, None, 2.0, None]


def test_confidence(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, None, 1.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(indices.evidence_confidence(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == pytest.approx([1.0, 0.6667], abs=1e-4)
    with pytest.raises(ValueError):
        indices.evidence_confidence()


# z_ndvi, z_r, delta, swi, expected
CELLS = [
    (-1.5, -1.5, 0.1, None, 1), (-1.0, -1.5, 0.1, None, 0), (-1.5, -0.8, 0.1, None, 0), (-1.5, 0.5, 0.1, 0.6, 2), (-0.3, -1.5, 0.05, 0.5, 3),
    (0.1, 1.0, -0.1, None, 4), (0.1, 0.5, -0.05, None, 4), (0.1, 0.6, 0.0, None, 4), (0.1, 0.2, 0.05, 0.4, 0), (-1.5, None, 0.1, None, -1),
    (None, -1.5, 0.1, None, 0), (None, None, None, None, -1), (-1.5, 0.5, 0.1, None, 0), (0.1, 1.5, None, None, 0), (-1.8, 0.8, -0.05, 0.45, 5),
    (-1.2, 0.5, 0.1, 0.6, 0), (0.0, -1.0, 0.1, 0.6, 0), (-1.5, 0.0, 0.1, 0.30, 2), (-0.5, -1.5, 0.1, 0.5, 3),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CELLS)], "i int, n double, r double, d double, s double")
    got = {r["i"]: r["c"] for r in df.select("i", cases.classify(F.col("n"), F.col("r"), F.col("d"), F.col("s")).alias("c")).collect()}
    assert [got[i] for i in range(len(CELLS))] == [c[4] for c in CELLS]
    off = df.where("i = 3").select(cases.classify(F.col("n"), F.col("r"), F.col("d"), F.col("s"), swi_enabled=False)).first()[0]
    assert off != 2


def test_equal_area_grid_corner(spark):
    df = spark.createDataFrame([(3400140.0, 81630.0)], "x double, y double")
    lon, lat = df.select(projection.cea_lon(F.col("x")), projection.cea_lat(F.col("y"))).first()
    back = spark.createDataFrame([(lon, lat)], "lon double, lat double").select(projection.cea_x(F.col("lon")), projection.cea_y(F.col("lat"))).first()
    assert back[0] == pytest.approx(3400140.0, abs=1e-4) and back[1] == pytest.approx(81630.0, abs=1e-3)
    assert lon == pytest.approx(35.239622, abs=1e-6)


def test_utm_central_meridian(spark):
    lat, lon = projection.utm_latlon(F.col("x"), F.col("y"))
    got = spark.createDataFrame([(500000.0, 10000000.0)], "x double, y double").select(lat, lon).first()
    assert got[0] == pytest.approx(0.0, abs=1e-9) and got[1] == pytest.approx(33.0)


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(33.0, 0.5), (35.25, 0.65), (30.1, -5.9), (35.9, -40.0)], "lon double, lat double")
    x, y = projection.utm_xy(F.col("lon"), F.col("lat"))
    df = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lat, lon = projection.utm_latlon(F.col("x"), F.col("y"))
    for r in df.select("*", lat.alias("lat2"), lon.alias("lon2")).collect():
        assert (r["lon2"], r["lat2"]) == (pytest.approx(r["lon"], abs=1e-7), pytest.approx(r["lat"], abs=1e-7))
    assert df.first()["x"] == 500000.0
