"""Gridded relations derived from the driver's tables, in Spark and in SQL alike.

Values are integers or quotients of integers, so both engines get the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_BIN = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, lat_i, lon_i, s1) from events."""
    return table(spark, sf_dir, "events").selectExpr("ts as t", "user_id div 15 as lat_i", "user_id % 15 as lon_i", "value / (value + 100) as s1")


SOIL = "soil AS (SELECT ts AS t, user_id // 15 AS lat_i, user_id % 15 AS lon_i, value / (value + 100) AS s1 FROM events)"


def optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, row, col, b02, b04, b08, scl) from lineitem."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_shipdate as t", "l_partkey % 10 as row", "l_suppkey % 10 as col", "cast(200 + 17 * l_quantity as int) as b02",
        "cast(300 + 31 * l_quantity as int) as b04", "cast(2000 + cast(floor(l_extendedprice) as bigint) % 4000 as int) as b08", "l_linenumber + 1 as scl",
    )


OPTICAL = """optical AS (SELECT l_shipdate AS t, l_partkey % 10 AS "row", l_suppkey % 10 AS col, CAST(floor(200 + 17 * l_quantity) AS INT) AS b02,
  CAST(floor(300 + 31 * l_quantity) AS INT) AS b04, CAST(2000 + CAST(floor(l_extendedprice) AS BIGINT) % 4000 AS INT) AS b08, l_linenumber + 1 AS scl FROM lineitem)"""


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, nation, rainfall) by month from orders and customers."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    months = joined.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("t"), F.col("c_nationkey").alias("nation"))
    return months.agg((F.floor(F.sum(F.floor(F.col("o_totalprice")).cast("bigint")) / F.count(F.lit(1))) / 1000).alias("rainfall"))


RAIN = """rain AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, c_nationkey AS nation,
  floor(CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) / count(*)) / 1000 AS rainfall
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def baseline(spark, sf_dir) -> DataFrame:
    return rain(spark, sf_dir).where("t between date'1995-01-01' and date'2000-12-31'")


def target(spark, sf_dir) -> DataFrame:
    return rain(spark, sf_dir).where("t >= date'2001-01-01'")


CLIM = RAIN + """, clim AS (SELECT month(t) AS m, nation, avg(rainfall) AS mean, stddev_pop(rainfall) AS std, count(rainfall) AS n
  FROM rain WHERE t BETWEEN DATE '1995-01-01' AND DATE '2000-12-31' GROUP BY 1, 2)"""


def screen_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bin, bin_start, row, col, z_ndvi, z_r, delta_swi_14d, swi) from lineitem: a bin for each year."""
    sums = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(year(l_shipdate) - 1995 as bigint) as bin", "l_partkey % 50 as row", "l_suppkey % 40 as col", "cast(round(l_quantity) as bigint) as q",
        "cast(round(l_discount * 100) as bigint) as d", "cast(round(l_tax * 100) as bigint) as x", "cast(floor(l_extendedprice) as bigint) as p",
    ).groupBy("bin", "row", "col").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in "qdxp"))
    return sums.selectExpr(
        "bin", "date_add(date'2023-03-01', cast(bin * 14 as int)) as bin_start", "row", "col",
        "case when n % 5 <> 0 then cast((floor(cast(q as double) * 1000 / n) / 1000 - 25.5D) / 6 as float) end as z_ndvi",
        "case when n % 7 <> 0 then cast((floor(cast(d as double) * 1000 / n) / 1000 - 5) / 2 as float) end as z_r",
        "case when n % 11 <> 0 then cast((floor(cast(x as double) * 1000 / n) / 1000 - 4) / 20 as float) end as delta_swi_14d",
        "case when n % 13 <> 0 then cast(floor(cast(p as double) / n) / 110000 as float) end as swi",
    )


SCREEN = """screen0 AS (SELECT CAST(year(l_shipdate) - 1995 AS BIGINT) AS bin, l_partkey % 50 AS "row", l_suppkey % 40 AS col, count(*) AS n,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS q, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS d,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS x, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS p
  FROM lineitem GROUP BY 1, 2, 3),
screen AS (SELECT bin, DATE '2023-03-01' + CAST(bin * 14 AS INT) AS bin_start, "row", col,
  CASE WHEN n % 5 <> 0 THEN CAST((floor(q * 1000 / n) / 1000 - 25.5::DOUBLE) / 6 AS FLOAT) END AS z_ndvi,
  CASE WHEN n % 7 <> 0 THEN CAST((floor(d * 1000 / n) / 1000 - 5) / 2 AS FLOAT) END AS z_r,
  CASE WHEN n % 11 <> 0 THEN CAST((floor(x * 1000 / n) / 1000 - 4) / 20 AS FLOAT) END AS delta_swi_14d,
  CASE WHEN n % 13 <> 0 THEN CAST(floor(p / n) / 110000 AS FLOAT) END AS swi FROM screen0)"""

CASES = SCREEN + """, fired AS (SELECT *,
  coalesce(z_r < CAST(-0.8 AS FLOAT) AND z_ndvi < CAST(-1.0 AS FLOAT), false) AS a,
  coalesce(z_r >= CAST(0.0 AS FLOAT) AND z_ndvi < CAST(-1.2 AS FLOAT) AND swi >= CAST(0.3 AS FLOAT), false) AS b,
  coalesce(z_r < CAST(-1.0 AS FLOAT) AND z_ndvi >= CAST(-0.5 AS FLOAT) AND swi >= CAST(0.3 AS FLOAT), false) AS c,
  coalesce(z_r >= CAST(0.5 AS FLOAT) AND delta_swi_14d <= CAST(0.0 AS FLOAT), false) AS d FROM screen),
cases AS (SELECT bin, bin_start, "row", col, z_ndvi, z_r, delta_swi_14d, swi, CAST(CASE WHEN a::INT + b::INT + c::INT + d::INT >= 2 THEN 5 WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 WHEN d THEN 4
  WHEN z_r IS NOT NULL AND (z_ndvi IS NOT NULL OR delta_swi_14d IS NOT NULL) THEN 0 ELSE -1 END AS TINYINT) AS diagnostic_case FROM fired)"""


def flagged(spark: SparkSession, sf_dir: str, above: float) -> DataFrame:
    """(bin, row, col): one bin of cells whose mean quantity is over a bound."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_partkey % 50").alias("row"), F.expr("l_suppkey % 40").alias("col")).agg(F.avg("l_quantity").alias("q"))
    return cells.where(F.col("q") > above).select(F.lit(0).cast("bigint").alias("bin"), "row", "col")


def flagged_sql(above: float) -> str:
    return f"""mask AS (SELECT 0::BIGINT AS bin, l_partkey % 50 AS "row", l_suppkey % 40 AS col FROM lineitem GROUP BY 2, 3 HAVING avg(l_quantity) > {above})"""


OPENED = """around AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j)),
eroded AS (SELECT "row" + i AS r, col + j AS c FROM mask, around GROUP BY 1, 2 HAVING count(*) = 9),
opened AS (SELECT DISTINCT r + i AS "row", c + j AS col FROM eroded, around)"""

LABELLED = """reach AS (SELECT "row", col, "row" * 1000000 + col AS root FROM cells
  UNION
  SELECT n."row", n.col, r.root FROM reach r JOIN cells n ON n."row" BETWEEN r."row" - 1 AND r."row" + 1 AND n.col BETWEEN r.col - 1 AND r.col + 1 WHERE n."row" * 1000000 + n.col > r.root),
roots AS (SELECT "row", col, min(root) AS root FROM reach GROUP BY 1, 2),
labels AS (SELECT "row", col, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS comp_id FROM roots)"""


OPENED_BINS = """around AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j)),
eroded AS (SELECT bin, "row" + i AS r, col + j AS c FROM mask, around GROUP BY 1, 2, 3 HAVING count(*) = 9),
opened AS (SELECT DISTINCT bin, r + i AS "row", c + j AS col FROM eroded, around)"""

LABELLED_BINS = """reach AS (SELECT bin, "row", col, "row" * 1000000 + col AS root FROM cells
  UNION
  SELECT n.bin, n."row", n.col, r.root FROM reach r JOIN cells n ON n.bin = r.bin AND n."row" BETWEEN r."row" - 1 AND r."row" + 1 AND n.col BETWEEN r.col - 1 AND r.col + 1 WHERE n."row" * 1000000 + n.col > r.root),
roots AS (SELECT bin, "row", col, min(root) AS root FROM reach GROUP BY 1, 2, 3),
labels AS (SELECT bin, "row", col, CAST(dense_rank() OVER (PARTITION BY bin ORDER BY root) AS INT) AS comp_id FROM roots)"""
