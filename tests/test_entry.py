"""Every registered query of the grid operators against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if v == v else "nan"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v


def test_queries_match_sql(spark):
    from pixelloom.plans import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql, wrong = catalog.oracle_sql(), []
    for name, f in catalog.queries().items():
        if name not in sql:
            continue
        df = f(spark, SF)
        cols = sorted(df.columns)
        found = con.execute(sql[name])
        names = [d[0] for d in found.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
        if sorted(names) != cols or got != want:
            wrong.append(name)
    assert not wrong


def test_season_summary_without_areas(spark, tmp_path):
    """Bins that are all without zones: the SQL names the first of them, and none of no bins."""
    from pixelloom.plans import catalog

    for name, rows in (("idle", "l_quantity > 30 and l_discount = 0.05"), ("empty", "false")):
        spark.read.parquet(f"{SF}/lineitem.parquet").where(rows).coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"create view lineitem as select * from '{tmp_path}/{name}/lineitem.parquet/*.parquet'")
        found = con.execute(catalog.oracle_sql()["season_summary"])
        want = dict(zip([d[0] for d in found.description], found.fetchall()[0], strict=True))
        got = catalog.queries()["season_summary"](spark, f"{tmp_path}/{name}").first().asDict()
        assert got == want and want["max_area_bin_index"] == {"idle": 1, "empty": None}[name] and not want["total_extracted_clusters"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_missing_dependency_leaves_the_rest(tmp_path):
    """With a dependency of the optional queries gone, the others register."""
    import subprocess
    import sys

    code = "import sys, warnings; sys.modules['tokenizers'] = None; sys.modules['regex'] = None; sys.modules['public_tokenizers'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(said[0]) > 60 and int(said[1]) > 60 and said[2] == "False"
