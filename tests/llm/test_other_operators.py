"""Components, URL filter, nearest neighbours, the pipeline and the registered queries."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import ann, queries, url_filter
from pixelloom.llm.graph import connected_components
from pixelloom.llm.sampling import hash_sample
from pixelloom.llm.sieve import sieve, sift

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 180)]
    loose = [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))]
    edges = chain + star + loose + [(500, 500), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == {v: root(v) for v in parent}
    assert connected_components(df.where("false")).count() == 0
    names = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    assert {r["component"] for r in connected_components(names).collect()} == {"a"}


def test_sieve(spark):
    rows = spark.range(3000).select((F.col("id") * 7).alias("k"), F.lit("x").alias("wide"))
    keys = spark.createDataFrame([(k,) for k in range(0, 700)] + [(None,)], "id bigint")
    maybe, none = sift(rows, sieve(keys, "id"), F.col("k"))
    passed, out = {r["k"] for r in maybe.collect()}, {r["k"] for r in none.collect()}
    assert {k for k in range(0, 700, 7)} <= passed and not passed & out and len(passed) + len(out) == 3000 and len(passed) < 200
    assert maybe.columns == rows.columns
    nothing, everything = sift(rows, sieve(keys.where("false"), "id"), F.col("k"))
    assert nothing.count() == 0 and everything.count() == 3000


def test_hash_sample(spark):
    rows = spark.createDataFrame([(k // 2,) for k in range(4000)], "k bigint").repartition(5)
    some = sorted(r["k"] for r in hash_sample(rows, ["k"], 50, 4000).collect())
    assert len(some) == len(set(some)) == 50
    assert some == sorted(r["k"] for r in hash_sample(rows.repartition(3), ["k"], 50, 4000).collect())
    assert len(hash_sample(rows, ["k"], 9000, 4000).collect()) == 2000
    assert hash_sample(rows.where("false"), ["k"], 5, 0).count() == 0


def page(k, url, head=""):
    return (k, url, f"<html><head>{head}</head></html>" if head is not None else None, "x")


PAGES = [
    page(1, "http://a.net/x", '<link rel="canonical" href="http://b.net/y">'),
    page(2, "http://b.net/y/", '<meta http-equiv="refresh" content="0; url=http://www.x.com/de/1">'),
    page(3, "http://fr.com/fr/1", '<link href="http://a.net/x" rel=canonical>'),
    page(4, "http://Q.net/z#a", None),
    page(5, None),
    page(6, "no scheme"),
    page(7, "https://EXAMPLE.org/en/12?q=1"),
    page(8, "http://sub.example.org/en/2"),
    page(9, "http://notexample.org/es/"),
    page(10, "http://example.org/es/"),
    page(11, "http://xcom/de/"),
    page(12, "http://q.net/alias", '<link rel="canonical" href="/z">'),
    page(12, "http://q.net/alias", '<link rel="canonical" href="/z">'),
]


def test_url_filter(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got[1] == ("a.net", "/x", None, "block") and got[2][3] == "block"
    assert got[3] == ("fr.com", "/fr/1", "com/fr/", "allow")  # its own rule outranks its aliases
    assert got[4] == ("q.net", "/z", None, "allow") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("example.org", "/en/12", "example.org/en/1", "block") and got[8][2:] == ("org/", "allow")
    assert got[9][2:] == ("org/", "allow") and got[10][2:] == ("example.org/es/", "block") and got[11][2:] == (None, "allow")
    moved = spark.createDataFrame([("http://q.net/z", "http://m.com/de/")], "src_url string, dst_url string")
    with_table = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, redirects=moved).collect()}
    assert with_table[4] == with_table[12] == "block"
    assert url_filter.judge(df.where("false")).count() == 0 and url_filter.judge(df).count() == len(PAGES)


LINKS = [
    ("http://h.com/a/b/c.html?x=1", "d.html", "http://h.com/a/b/d.html"), ("http://h.com/a/b/c.html", "../d?y=2#z", "http://h.com/a/d?y=2#z"), ("http://h.com/a/b/c", "?id=3", "http://h.com/a/b/c?id=3"),
    ("https://h.com", "x/y", "https://h.com/x/y"), ("https://h.com/q", "//o.org/p", "https://o.org/p"), ("https://h.com:81/q/", "./r/../s/.", "https://h.com:81/q/s/"), ("http://h.com/a", "../../up", "http://h.com/up"),
    ("http://h.com/a", "/login?next=http://o.org/", "http://h.com/login?next=http://o.org/"), ("http://h.com/a", "mailto:x@o.org", None), ("http://h.com/a", "#f", None), ("http://h.com/a", "", None), ("nowhere", "b", None),
    ("nowhere", "HTTPS://o.org/", "HTTPS://o.org/"), ("http://h.com/a", None, None), (None, "b", None),
]


def test_targets_of_links(spark):
    df = spark.createDataFrame(LINKS, "base string, target string, want string")
    for r in df.withColumn("got", url_filter.absolute(F.col("target"), F.col("base"))).collect():
        assert r["got"] == r["want"], r


def test_links_of_pages(spark):
    heads = [
        ('<link rel=canonical href=one><LINK href="two?a=1&amp;b=2" rel="shortlink Canonical"><link rel=nocanonical href=no><link data-rel=canonical href=no>', {"http://h.com/d/one", "http://h.com/d/two?a=1&b=2"}),
        ('<meta http-equiv="refresh" content="5"><meta content="0;URL=\'/three\'" http-equiv=REFRESH><meta name=refresh content="0;url=/no">', {"http://h.com/three"}),
        ("<!-- <link rel=canonical href=no> --><base href='/x/'><base href='/y/'><link rel='canonical' href='&#102;our&#x2e;html'>", {"http://h.com/x/four.html"}),
        ("<link rel=canonical><link rel=canonical href=''><p>canonical refresh</p>", set()), (None, set()),
    ]
    for head, want in heads:
        df = spark.createDataFrame([(1, "http://h.com/d/p.html", head)], "page_id bigint, url string, html string")
        assert {r["dst_url"] for r in url_filter.page_links(df).collect()} == want, head


def test_url_filter_against_sql(spark):
    more = [
        page(13, "http://r.net/a/b", '<link rel=canonical href="c"><link rel=canonical href="?id=3">'), page(14, "http://r.net/a/c", '<link href="http://de.com/de/" rel="x canonical">'),
        page(15, "http://r.net/a/b?id=3"), page(16, "http://r.net/a/d", '<meta http-equiv=refresh content="0;url=b?id=3&amp;utm_x=1">'), page(17, "http://r.net/a/e"),
    ]
    df = spark.createDataFrame(PAGES + more, "page_id bigint, url string, html string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(df).collect() if r["page_id"] > 12} == {13: "block", 14: "block", 15: "block", 16: "block", 17: "allow"}
    con = duckdb.connect()
    con.register("pages", df.drop("verdict").toPandas())
    found = con.execute(url_filter.OP6_SQL)
    names = [d[0] for d in found.description]
    want = sorted(tuple(map(str, r)) for r in found.fetchall())
    assert sorted(tuple(str(r[n]) for n in names) for r in url_filter.judge(df).collect()) == want


def neighbours(x, ids, q, own, k):
    score = (x * q).sum(1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != own][:k]
    return [int(ids[i]) for i in order]


@pytest.mark.parametrize(("block", "wave"), [(ann.BLOCK, ann.WAVE), (500, 40)])
def test_nearest_neighbours(spark, block, wave, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_BLOCK", min(block, ann.LEAST_BLOCK))
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 24))).astype(np.float32)
    x[1000:1400] = x[0]  # one vector that many rows share
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9020, [None] * 24), (9040, [1.0]), (9060, []), (None, [1.0] * 24), (20, [float(v) for v in x[20]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), list_size=100, block=block, wave=wave).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    wide, ids, hit = x.astype(float), np.arange(3000), 0
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        want = neighbours(wide, ids, wide[q], q, 20)
        mine = [found[k][0] for k in range(1, 21)]
        hit += len(set(want) & set(mine))
        assert all(found[k][1] == pytest.approx(float((wide[found[k][0]] * wide[q]).sum())) for k in found)
        if wide[q].tolist() == wide[0].tolist():
            assert mine[:5] == want[:5]
    assert hit / (20 * len(got)) >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)]
    assert ann.search(df.where("false"), df.where("false")).count() == 0


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    made = queries.queries()
    for name, sql in queries.oracle_sql().items():
        df = made[name](spark, SF)
        cols = sorted(df.columns)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == cols, name
        want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in found.fetchall())
        assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want, name


@needs_tables
def test_registration():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {n[: n.index("_") + 1] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline as p
    from pixelloom.session import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in p.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "exact_dedup":
            norm = lambda r: "".join((r["text"] or "").split(" ")).translate(str.maketrans("", "", "\t\n\x0b\x0c\r"))
            texts = {norm(r) for r in before.collect()}
            assert docs.count() == len(texts)
        if name == "secrets":
            assert docs.count() == before.count()
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]
    whole = p.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1]
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        none = materialize(stage(spark, none, SF), "none")
    assert none.count() == 0
