"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct word shingles.  Two collections of ``TABLES`` hash
groups, ``WIDTH`` minhashes each, are all that is computed; every pair of a group of the
first and a group of the second collection is a table key, so 2 * 16 * 3 minhashes give
16 * 16 tables of six.  Two sets of similarity 0.8 miss all tables with odds of
2 * (1 - 0.8**3)**16, about 2e-5.  A pair of groups is only formed where other sets share
each of the two groups by itself, which loses no key that two sets share.

Equal sets fold into one class first.  Links are confirmed on the full sets:

1. each set against the one of its buckets' smallest members that it shares most tables
   with, and the two sets of every bucket of two, then connected components;
2. in larger buckets that still hold two components, each set against the leader, drawn at
   random, that it shares most tables with, then components again;
3. what is left, whole: sets of those buckets that share a group of the first collection
   and are of different components are compared by sketches of ``SKETCH`` one-byte
   minhashes, block against block; pairs within ``DEVIATIONS`` standard deviations of the
   least similarity (odds of 4e-6 to miss one) are confirmed.

So a large group of copies costs a star and not all its pairs, and of a large bucket of
sets that are not copies only those pairs leave a task that may be.  No bucket is capped.

Results for odd input: a null or empty text, or one without words, has an empty set and
is linked with nothing, not even with its like; a text with fewer words than a shingle is
one shingle; a null doc_id is linked with nothing and has a null component; repeated rows
get the same result; other columns are ignored; an empty table gives no rows.  Ids are cast to
bigint: a string that is no integer raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.graph import connected_components
from pixelloom.llm.sieve import fresh, sieve, sift
from pixelloom.llm.tokens import Words, mix, text_windows, tidied
from pixelloom.session import files_for, free, materialize

TABLES = 16  # hash groups in each of the two collections
WIDTH = 3  # minhashes in a group
SHINGLE = 5
PERCENT = 80
SKETCH = 1_024
DEVIATIONS = 4.5
BLOCK = 2_048  # sets of one group that a task holds, twice
FILE_SETS = 1_000  # sets for each file of a table with many rows, or wide ones, for a set

_RNG = np.random.default_rng(77)
_A = _RNG.integers(1, 2**63, 2 * TABLES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, 2 * TABLES * WIDTH, dtype=np.uint64)
_C = _RNG.integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = mix(np.arange(1, 2 * TABLES + 1, dtype=np.uint64))


def groups_of(shingles: np.ndarray) -> np.ndarray:
    """The 2 * TABLES group hashes of a set; the lowest bit tells the collection."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        low = np.minimum(low, (shingles[k : k + 512, None] * _A + _B).min(axis=0))
    low = (low >> np.uint64(24)).reshape(2 * TABLES, WIDTH)
    out = _SALT.copy()
    for k in range(WIDTH):
        out = mix(out ^ mix(low[:, k] + np.uint64(k + 1)))
    side = np.repeat(np.array([0, 1], np.uint64), TABLES)
    return (out & ~np.uint64(1)) | side


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row's text."""
    for lo, hi, data, offsets in text_windows(batch, "text"):
        words = Words(data, offsets)
        for i in range(hi - lo):
            yield np.unique(words.shingles(i, width))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, groups) of every row; digest and groups are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, groups = [], [], []
            for s in _sets(batch, width):
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                groups.append(groups_of(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(groups, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "groups"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(tidied(run), "doc_id bigint, n_shingles bigint, digest binary, groups array<bigint>")


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, shingles) of the documents with these ids, read from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, len(batch), 512)):
                sets = list(_sets(part, width))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "shingles"])

    maybe, _ = sift(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), sieve(ids, "id"), F.col("doc_id"))
    found = maybe.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return found.mapInArrow(tidied(run), "id bigint, n bigint, shingles binary").dropDuplicates(["id"])


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """One byte of each of SKETCH further minhashes."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 256):
        low = np.minimum(low, (shingles[k : k + 256, None] * _C).min(axis=0))
    return (mix(low) >> np.uint64(56)).astype(np.uint8)


def least_matches(percent: int) -> int:
    """Sketch bytes that two sets of the least similarity share, less DEVIATIONS."""
    p = percent / 100
    p = p + (1 - p) / 256
    return int(np.floor(SKETCH * p - DEVIATIONS * np.sqrt(SKETCH * p * (1 - p))))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (src, dst) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["src", "dst"])

    left = sets.select(F.col("id").alias("src"), F.col("n").alias("n_src"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("dst"), F.col("n").alias("n_dst"), F.col("shingles").alias("t"))
    near = (F.col("n_src") * 100 >= F.col("n_dst") * percent) & (F.col("n_dst") * 100 >= F.col("n_src") * percent)
    both = pairs.select("src", "dst").join(left, "src").join(right, "dst").where(near)
    return both.select("src", "dst", "s", "t").mapInArrow(tidied(run), "src bigint, dst bigint")


def _labelled(members: DataFrame, parts: DataFrame, key: str = "id") -> DataFrame:
    """``members`` with the component of each id: its own id where it has none yet."""
    named = parts.select(F.col("id").alias(key), "component")
    return members.join(named, key, "left").withColumn("component", F.coalesce("component", key))


def _closest(met: DataFrame) -> DataFrame:
    """Of (id, other) rows, one pair for each id: the other that it meets most often."""
    counts = met.groupBy("id", "other").agg(F.count(F.lit(1)).alias("times"))
    best = counts.groupBy("id").agg(F.max(F.struct("times", (-F.col("other")).alias("minus"))).alias("best"))
    other = -F.col("best.minus")
    return best.select(F.greatest("id", other).alias("src"), F.least("id", other).alias("dst"))


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of buckets that hold two components, with a leader for each bucket.

    Buckets of two are left out: the first round has tested their only pair.
    """
    placed = _labelled(members.where("size > 2").select("key", "id"), parts)
    draw = F.xxhash64("key", "id")
    spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("id", "component"), draw).alias("leader")).where("lo <> hi")
    return placed.join(spread.select("key", F.col("leader.id").alias("other"), F.col("leader.component").alias("led")), "key")


def _sketched_pairs(ids: DataFrame, own: DataFrame, sets: DataFrame, parts: DataFrame, percent: int, files: int) -> DataFrame:
    """Pairs of different components among ``ids`` that share a group of the first collection and may be similar enough."""
    least = least_matches(percent)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch_of(np.frombuffer(x.as_py(), np.uint64)).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["id", "n", "sketch"])

    drawn = sets.join(ids, "id", "left_semi").select("id", "n", "shingles").mapInArrow(tidied(sketches), "id bigint, n bigint, sketch binary")
    rows = _labelled(drawn, parts).join(own.select("id", F.slice("groups", 1, TABLES).alias("a")), "id")
    rows = materialize(rows.select("id", "component", "n", "a", "sketch"), "sketches", files)
    keys = rows.select("id", "component", F.posexplode("a").alias("place", "g"))
    groups = keys.groupBy("g", "place").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    blocks = F.ceil(F.col("size") / BLOCK)
    mine = keys.join(groups.select("g", "place", blocks.alias("blocks")), ["g", "place"]).select("id", "g", "place", "blocks")
    mine = mine.withColumn("block", F.pmod(F.xxhash64("id", "g"), F.col("blocks")))
    mine = mine.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    mine = mine.select("id", "g", "place", "block", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))

    def compare(table: pa.Table) -> pa.Table:
        src, dst = [], []
        if len(table) > 1:
            ids, part, n, block = (table.column(c).to_numpy() for c in ("id", "component", "n", "block"))
            place, x, y = (table.column(c)[0].as_py() for c in ("place", "x", "y"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            a = np.array(table.column("a").to_pylist(), np.int64)
            for i in range(len(ids)):
                others = np.arange(i + 1, len(ids)) if x == y else np.flatnonzero(block == y) if block[i] == x else np.zeros(0, np.int64)
                fits = (part[others] != part[i]) & (100 * n[others] >= percent * n[i]) & (100 * n[i] >= percent * n[others])
                others = others[fits]
                others = others[np.count_nonzero(sketch[others] == sketch[i], axis=1) >= least]
                others = others[(a[others, :place] != a[i, :place]).all(1)]  # a pair leaves from the first group it shares
                src.append(np.maximum(ids[others], ids[i]))
                dst.append(np.minimum(ids[others], ids[i]))
        src, dst = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in (src, dst))
        return pa.table([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return mine.join(rows, "id").groupBy("g", "place", "x", "y").applyInArrow(compare, "src bigint, dst bigint")


def near_groups(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    return _grouped(docs, width, percent)[0]


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The groups, and the written tables that they are read from."""
    marks = materialize(signatures(docs, width), "signatures")
    full = marks.where("digest is not null and doc_id is not null")
    n = marks.count()
    few, some = files_for(n), files_for(n, FILE_SETS)
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes", few)
    own = full.join(classes.select("id"), full["doc_id"] == classes["id"], "left_semi").select(F.col("doc_id").alias("id"), "groups")

    rows = own.select("id", F.explode("groups").alias("g"))
    shared = rows.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("g")
    left = rows.join(shared, "g", "left_semi")
    sides = left.groupBy("id").agg(F.collect_set(F.when(F.col("g").bitwiseAND(1) == 0, F.col("g"))).alias("a"), F.collect_set(F.when(F.col("g").bitwiseAND(1) == 1, F.col("g"))).alias("b"))  # TABLES at most
    keys = sides.select("id", F.explode("a").alias("a"), "b").select("id", "a", F.explode("b").alias("b")).select("id", F.xxhash64("a", "b").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    members = materialize(keys.join(buckets.select("key", "lo", "size"), "key"), "buckets", some)

    wanted = materialize(members.select("id").distinct(), "candidates", few)
    sets = materialize(_full_sets(docs, wanted, width), "sets", some)
    met = members.where("id <> lo").select("id", F.col("lo").alias("other"), "size")
    twos = met.where("size = 2").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    links = materialize(_confirmed(_closest(met).unionByName(twos).distinct(), sets, percent), "links", some)
    parts = connected_components(links, most=links.count())
    done = [wanted]
    for last in (False, True):
        still = materialize(_open(members, parts), "open", some)
        if still.isEmpty():
            break
        pairs = _sketched_pairs(still.select("id").distinct(), own, sets, parts, percent, some) if last else _closest(still.where("component <> led").select("id", "other"))
        more = materialize(_confirmed(pairs, sets, percent), "links", some)
        done += [still, more]
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = connected_components(links, most=links.count())
    free(members, sets, *done)

    named = _labelled(classes, parts).select(F.col("digest").alias("of"), "component")
    out = marks.select("doc_id", "n_shingles", "digest").join(named, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), [marks, classes]


def keep_one(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group, every column."""
    (out,) = fresh(docs, "out")
    groups, tables = _grouped(docs, width, percent)
    gone = materialize(groups.where("not kept").select(F.col("doc_id").alias(out)).distinct(), "gone", files_for(tables[0].count()))
    free(*tables)
    maybe, sure = sift(docs, sieve(gone, out), F.col("doc_id").cast("bigint"))
    return sure.unionByName(maybe.join(gone, F.col("doc_id").cast("bigint") == F.col(out), "left_anti"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [words]
         ELSE list_distinct([words[i:i+3] FOR i IN range(1, len(words) - 2)]) END AS shingles
  FROM w),
u AS (
  SELECT doc_id, len(shingles) AS n_shingles, CASE WHEN len(shingles) > 0 THEN md5(list_sort(shingles)::VARCHAR) END AS digest, shingles FROM s),
r AS (
  SELECT min(doc_id) AS id, any_value(n_shingles) AS n, any_value(shingles) AS shingles, digest FROM u WHERE digest IS NOT NULL GROUP BY digest),
x AS (
  SELECT id, n, unnest([hash(q) FOR q IN shingles]) AS h FROM r),
pairs AS (
  SELECT a.id AS i, b.id AS j FROM x a JOIN x b ON a.h = b.h AND a.id < b.id
  WHERE 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs),
reach AS (
  SELECT id AS v, id AS c FROM r
  UNION
  SELECT e.j, reach.c FROM reach JOIN both_ways e ON reach.v = e.i WHERE reach.c < e.j),
parts AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT u.doc_id, u.n_shingles, coalesce(parts.c, u.doc_id) AS component_id, u.doc_id = coalesce(parts.c, u.doc_id) AS kept
FROM u LEFT JOIN r ON u.digest = r.digest LEFT JOIN parts ON parts.v = r.id
"""
