"""Loaders, checks and provenance."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pixelloom.errors import RangeError
from pixelloom.sources import gridded
from pixelloom.streaming import streaming_bins, window_start


def soil(spark, hours=3, days=5, fill=None):
    rows = [(datetime(2023, 3, 1) + timedelta(hours=hours * k), 0.08 * i, 35 + 0.08 * j, 0.2 + 0.01 * (k % 8)) for k in range(days * 24 // hours) for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, sm_rootzone_wetness double")


def test_subdaily_soil_becomes_daily(spark):
    got = gridded.load_soil_subdaily(spark, soil(spark), (35.0, 0.0, 35.08, 0.08), "2023-03-01", "2023-03-06")
    assert got.select("t").distinct().count() == 5 and got.select("lat").distinct().count() == 2
    assert got.first()["s1"] == pytest.approx(0.235)


def test_an_end_date_is_its_midnight(spark):
    got = gridded.load_soil_subdaily(spark, soil(spark), (35.0, 0.0, 35.08, 0.08), "2023-03-01", "2023-03-05")
    last = got.where("t = date'2023-03-05'").first()
    assert last["s1"] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        gridded.load_soil_subdaily(spark, soil(spark), (35, 0, 36, 1), "2023-03-05", "2023-03-01")


def test_percent_and_fill(spark):
    rows = [(datetime(2023, 3, 1), 0.0, 35.0, v) for v in (50.0, -9999.0, 100.0, float("nan"))]
    df = spark.createDataFrame(rows, "time timestamp, lat double, lon double, s1 double")
    got = sorted((r["s1"] for r in gridded.load_soil(spark, df, (34, -1, 36, 1), "2023-01-01", "2023-12-31").collect()), key=lambda v: (v is None, v))
    assert got == [0.5, 1.0, None, None]


def test_rainfall(spark):
    rows = [(datetime(2023, 3, 1) + timedelta(days=k), 0.05 * k, 35.0, v) for k, v in enumerate((3.0, -1.0, -9999.0, 7.0))]
    df = spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, precip double")
    got = gridded.load_rainfall(spark, df, (34, 0.0, 36, 1), "2023-03-01", "2023-03-04").orderBy("t")
    assert [r["rainfall"] for r in got.collect()] == [3.0, None, None, 7.0]
    gridded.validate_rainfall(got)
    with pytest.raises(ValueError):
        gridded.validate_rainfall(got, units="inch")
    with pytest.raises(RangeError):
        gridded.validate_rainfall(got.withColumn("rainfall", F.lit(2000.0)))


def test_optical(spark):
    df = spark.createDataFrame([(datetime(2023, 3, 1), 0, 0, 1000, 4), (datetime(2023, 4, 1), 0, 0, 30000, 4)], "t timestamp, row int, col int, B04 int, SCL int")
    got = gridded.load_optical(spark, df, ["B04", "scl", "B08"], "2023-03-01", "2023-03-02")
    assert got.columns == ["t", "row", "col", "B04", "SCL"] and got.count() == 1 and dict(got.dtypes)["B04"] == "int"
    gridded.validate_optical(got)
    with pytest.raises(RangeError):
        gridded.validate_optical(df)
    with pytest.raises(ValueError):
        gridded.load_optical(spark, df, ["B99"], "2023-03-01", "2023-03-02")


def test_crop_mask(spark):
    classes = spark.createDataFrame([(0, 40.0), (1, 10.0), (2, None)], "i int, crop_mask double")
    got = {r["i"]: r["crop_mask"] for r in gridded.load_crop_mask(spark, classes).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: None}
    gridded.validate_crop_mask(gridded.load_crop_mask(spark, classes))
    with pytest.raises(RangeError):
        gridded.validate_crop_mask(classes)


def test_days_and_addresses(spark):
    df = spark.createDataFrame([(19417.5,), (-1.0,), (None,), (1e6,), (float("inf"),)], "days double")
    got = gridded.decode_days(df).collect()
    assert len(got) == 1 and str(got[0]["t"]).startswith("2023-03-01 12:00")
    assert gridded.archive_url("rootzone", 2022, "http://x/").endswith("_2022.nc")
    with pytest.raises(ValueError):
        gridded.archive_url("s9", 2022, "http://x")


def test_retry():
    calls, waits = [], []

    def fails():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(ConnectionError):
        gridded.with_retry(fails, sleep=waits.append)
    assert len(calls) == 3 and waits == [1.5, 3.0]
    assert gridded.granules(lambda q: {"feed": {"entry": [q["short_name"]]}}, (0, 0, 1, 1), "a", "b", "n") == ["n"]


def test_provenance(spark):
    attrs = gridded.provenance("s", "p", "1", "30 m", "14 d", "EPSG:6933", ["a", "b"], extra={"k": 3})
    assert attrs["provenance_known_limitations"] == "a; b" and attrs["provenance_transformations_applied"] == "none" and attrs["provenance_k"] == "3"
    gridded.validate_provenance(attrs)
    with pytest.raises(ValueError):
        gridded.validate_provenance({})
    cube = gridded.Cube((0, 0, 1, 1), {"climate": gridded.attach_provenance(spark.createDataFrame([(1.0,)], "rainfall double"), attrs)})
    cube.validate(["climate"])
    assert cube.summary() == {"climate": {"variables": ["rainfall"], "rows": 1}}
    with pytest.raises(ValueError):
        cube.validate(["optical"])


def test_streaming_bins(spark, tmp_path):
    from datetime import date

    assert window_start(date(2023, 3, 1), 14) == "13 days"
    rows = [(datetime(2023, 3, 1) + timedelta(days=k), 0, float(k)) for k in (0, 13, 14, 60)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "t timestamp, cell int, v double").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("t timestamp, cell int, v double").parquet(path)
    q = streaming_bins(stream, "v", date(2023, 3, 1), ["cell"]).writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {str(r["bin_start"]): (r["mean"], r["count"]) for r in spark.table("bins").collect()}
    assert got["2023-03-01"] == (6.5, 2) and got["2023-03-15"] == (14.0, 1)


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(datetime(2023, 3, 1) + timedelta(days=k), 0.05 * i, 35.0 + 0.05 * i, float(k), 0.5) for k in range(10) for i in range(6)]
    path = str(tmp_path / "grid")
    spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, precip double, s1 double").write.parquet(path)

    def pushed(df):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return plan[plan.index("PushedFilters") :]

    for df in (gridded.load_rainfall(spark, path, (35.0, 0.0, 35.1, 0.1), "2023-03-02", "2023-03-04"), gridded.load_soil_subdaily(spark, path, (35.0, 0.0, 35.1, 0.1), "2023-03-02", "2023-03-04")):
        said = pushed(df)
        assert all(f"{op}({c}," in said for c in ("latitude", "longitude", "time") for op in ("GreaterThanOrEqual", "LessThanOrEqual"))
    assert gridded.load_rainfall(spark, path, (35.0, 0.0, 35.1, 0.1), "2023-03-02", "2023-03-04").count() == 9


def test_coordinates_that_are_no_number(spark):
    nan = float("nan")
    rows = [(datetime(2023, 3, 1), lat, lon, 1.0) for lat, lon in ((0.0, 35.0), (nan, 35.0), (0.0, nan), (None, 35.0), (0.1, 35.1))]
    df = spark.createDataFrame(rows, "t timestamp, lat double, lon double, s1 double")
    assert gridded.load_soil(spark, df, (34, -1, 36, 1), "2023-01-01", "2023-12-31").count() == 2


def test_parts_and_variables(spark):
    day = [datetime(2023, 3, k) for k in (1, 2, 3)]
    s0 = spark.createDataFrame([(day[0], 0.0, 35.0, 50.0), (day[1], 0.0, 35.0, 60.0)], "time timestamp, lat double, lon double, s0 double")
    s1 = [spark.createDataFrame([(d, 0.0, 35.0, v)], "time timestamp, lat double, lon double, s1 double") for d, v in zip(day[1:], (0.2, 0.3), strict=True)]
    got = {r["t"].day: (r["s0"], r["s1"]) for r in gridded.load_soil(spark, {"s0": s0, "s1": s1}, (34, -1, 36, 1), "2023-01-01", "2023-12-31").collect()}
    assert got == {1: (0.5, None), 2: (0.6, 0.2), 3: (None, 0.3)}
    both = gridded.read(spark, [s0, s1[0]])
    assert both.columns == ["t", "lat", "lon", "s0", "s1"] and both.count() == 3
    for bad in (lambda: gridded.concat([]), lambda: gridded.merge({})):
        with pytest.raises(ValueError):
            bad()


def test_soil_checks(spark):
    df = spark.createDataFrame([(1, datetime(2023, 3, 1), 0.2, 50.0), (2, datetime(2023, 3, 2), 1.0, 100.0)], "k int, t timestamp, s0 double, s1 double")
    gridded.validate_soil(df, ("s0",), ordinal="k")
    gridded.validate_soil(df, percent=True)
    with pytest.raises(RangeError):
        gridded.validate_soil(df)
    with pytest.raises(ValueError):
        gridded.validate_soil(df.withColumn("k", -F.col("k")), ("s0",), ordinal="k")


def test_pages_of_granules():
    entries, asked = [{"id": k} for k in range(7)], []

    def fetch(query):
        asked.append(query["page_num"])
        a = (query["page_num"] - 1) * query["page_size"]
        return {"feed": {"entry": entries[a : a + query["page_size"]]}}

    assert gridded.granules(fetch, (35, 0, 36, 1), "2023-03-01", "2023-03-02", "X", page_size=3) == entries and asked == [1, 2, 3]
    assert gridded.granules(lambda q: {}, (35, 0, 36, 1), "a", "b", "X") == []
