"""Approximate nearest neighbours by largest inner product, with an adaptive dimension scan.

Vectors gain one coordinate that makes all norms equal, so that the largest inner product
is the smallest distance, and are rotated at random.  An inverted file over k-means
centroids (fitted on at most ``SAMPLE`` vectors, every vector indexed) deals them into
lists; a query scans the ``PROBES`` share of the lists that is nearest to it.  A scan takes the rotated columns in
blocks of ``COLUMNS``; after each block a hypothesis test on the partial distance abandons
the candidates whose whole distance cannot be expected to beat the best known so far.
Survivors are scored exactly, in double precision on the original vectors.

Equal vectors are folded before the shuffle: of a vector's copies only the ``k + 1``
smallest ids can be anyone's neighbours, ties going to the smaller id.  Equal queries are
searched once.  Lists are put together to cells of at most about ``BLOCK`` vectors, longer
ones are split.  A task holds one cell and scans it for ``WAVE`` queries at most, which it
reads in batches; so of n rows and q queries about n * q / WAVE vectors and q * n / BLOCK
queries move.

Results for odd input: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those without a vec_id or of another than the most
frequent length (the longer one on a tie); repeated rows of one vec_id count once, and
of different vectors under one vec_id the better one, which can leave fewer than k; with
fewer candidates than k, all of them are returned; other columns are ignored; an empty
table gives no rows; ids are cast to bigint, and a string that is no integer raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.sampling import hash_sample
from pixelloom.llm.tokens import tidied
from pixelloom.session import materialize

K = 20
SAMPLE = 16_384  # vectors the centroids are fitted on, at most
LIST = 400  # vectors in a list, on average, up to MOST_LISTS
MOST_LISTS = 2_048
PROBES = 0.75  # share of the lists that a query scans: vectors without clusters need as many
BLOCK = 65_536  # vectors of a cell, at most about; fewer where that would leave cores idle
LEAST_BLOCK = 2_048
WAVE = 65_536  # queries that a cell is scanned for in one task
COLUMNS = 16
EPSILON = 2.1


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means with a fixed seed; an empty list takes the point farthest from its centroid."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        sums, sizes = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        far = np.argsort(-((x - c[near]) ** 2).sum(1))
        empty = np.flatnonzero(sizes == 0)
        c = sums / np.maximum(sizes, 1)[:, None]
        c[empty] = x[far[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    n = min(n, len(c))
    out = np.empty((len(x), n), np.int64)
    for k in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[k : k + 4096] @ c.T
        part = np.argpartition(d, n - 1, 1)[:, :n] if n < len(c) else np.tile(np.arange(n), (len(d), 1))
        out[k : k + 4096] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable"), 1)
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate, so that every row has the squared norm ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


class Cell:
    """Vectors of some lists, rotated and cut into blocks of columns."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, turn: np.ndarray, top: float, columns: int = COLUMNS):
        order = np.argsort(lists, kind="stable")
        self.ids, self.x, self.lists = ids[order], x[order], lists[order]
        xr = (lifted(self.x, top) @ turn).astype(np.float32)
        self.turn, self.d = turn, xr.shape[1]
        self.cuts = [(a, min(self.d, a + columns)) for a in range(0, self.d, columns)]
        self.blocks = [np.ascontiguousarray(xr[:, a:b]) for a, b in self.cuts]
        self.squares = (self.blocks[0] ** 2).sum(1)

    def near(self, q: np.ndarray, probes: list[np.ndarray], k: int, epsilon: float = EPSILON) -> Iterator[np.ndarray]:
        """For each query the rows of its probed lists that no test abandoned; ``probes`` are nearest first."""
        qr = (np.hstack([q, np.zeros((len(q), 1))]) @ self.turn).astype(np.float32)
        for lo in range(0, len(q), 64):
            first = qr[lo : lo + 64, : self.cuts[0][1]]
            partial = self.squares[:, None] + (first**2).sum(1) - 2 * self.blocks[0] @ first.T
            for i in range(partial.shape[1]):
                yield self._scan(qr[lo + i], partial[:, i], probes[lo + i], k, epsilon)

    def _whole(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return sum(((x[rows] - q[a:b]) ** 2).sum(1) for x, (a, b) in zip(self.blocks, self.cuts, strict=True))

    def _scan(self, q: np.ndarray, partial: np.ndarray, probes: np.ndarray, k: int, epsilon: float) -> np.ndarray:
        lows = np.searchsorted(self.lists, probes, "left")
        highs = np.searchsorted(self.lists, probes, "right")
        rows = np.concatenate([np.arange(a, b) for a, b in zip(lows, highs, strict=True)])
        if len(rows) <= 4 * k:
            return rows
        # the exact distances of those that look nearest so far bound what can still win
        p = partial[rows]
        probe = rows[np.argpartition(p, 3 * k)[: 3 * k]]
        radius = np.partition(self._whole(probe, q), k - 1)[k - 1]
        for (a, b), x in zip(self.cuts, self.blocks, strict=True):
            if a:
                p = p + ((x[rows] - q[a:b]) ** 2).sum(1)
            slack = 1e-5 * (1 + radius)
            bound = radius + slack if b == self.d else radius * b / self.d * (1 + epsilon / np.sqrt(b)) ** 2 + slack
            good = p <= bound
            rows, p = rows[good], p[good]
            if 4 * k < len(rows) and b < self.d:
                probe = rows[np.argpartition(p, 2 * k)[: 2 * k]]
                radius = min(radius, np.partition(self._whole(probe, q), k - 1)[k - 1])
        return rows


def usable(vector: Column) -> Column:
    return F.coalesce(
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _folded(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Row numbers that remain when each vector keeps its ``most`` smallest ids."""
    rows = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8)))[:, 0]
    _, kind = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, kind))
    again = np.r_[False, (kind[order][1:] == kind[order][:-1]) & (ids[order][1:] == ids[order][:-1])]
    order = order[~again]  # a repeated row counts once
    kind = kind[order]
    first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    place = np.arange(len(kind)) - np.repeat(first, np.diff(np.r_[first, len(kind)]))
    return order[place < most]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: float = PROBES, list_size: int = LIST, block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` found for each of ``queries``.

    Both have vec_id and embedding; a query's own vec_id is no candidate for it.
    """
    spark = vectors.sparkSession
    good = [df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) for df in (vectors, queries)]
    x, q = good
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    facts = x.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if facts is None:
        return spark.createDataFrame([], schema)
    d, n, top = facts["d"], facts["n"], float(facts["top"])
    x, q = x.where(F.size("embedding") == d), q.where(F.size("embedding") == d)

    rows = hash_sample(x, ["vec_id"], SAMPLE, n).select("embedding").toArrow()
    turn = rotation(d + 1)
    sample = lifted(_matrix(rows.column(0), d), top) @ turn
    lists = int(np.clip(round(n / list_size), 1, min(MOST_LISTS, max(1, len(sample) // 8))))
    sent = spark.sparkContext.broadcast((fit_centroids(sample, lists), turn))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, turn = sent.value
        for batch in batches:
            if not len(batch):
                continue
            ids, m = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), d)
            keep = np.sort(_folded(ids, m, k + 1))
            where = nearest(lifted(m[keep], top) @ turn, centroids, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *(c.take(pa.array(keep)) for c in batch.columns)], names=["list", "vec_id", "embedding"])

    indexed = materialize(x.mapInArrow(tidied(assign), "list int, vec_id bigint, embedding array<double>"), "lists")
    sizes = np.zeros(len(sent.value[0]), np.int64)
    for row in indexed.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[row["list"]] = row["count"]
    # lists go to cells of about ``block`` vectors; a longer list gets cells of its own
    block = int(min(block, max(LEAST_BLOCK, n // (2 * spark.sparkContext.defaultParallelism))))
    blocks = np.maximum(1, -(-sizes // block))
    cell_of, cells, filled = np.zeros(len(sizes), np.int64), 0, 0
    for c, size in enumerate(sizes):
        if blocks[c] > 1 or filled + size > block:
            cells, filled = cells + 1, 0
        cell_of[c] = cells
        filled += size
        if blocks[c] > 1:
            cells, filled = cells + int(blocks[c]), 0

    kinds = q.groupBy("embedding").agg(F.min("vec_id").alias("kind"))
    probe = spark.sparkContext.broadcast((sizes, blocks, cell_of))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, turn = sent.value
        sizes, blocks, cell_of = probe.value
        for batch in batches:
            for some in (batch.slice(a, 512) for a in range(0, len(batch), 512)):
                m = _matrix(some.column(1), d)
                near = nearest(np.hstack([m, np.zeros((len(m), 1))]) @ turn, centroids, len(centroids))
                row, cell, lists = [], [], []
                for i, order in enumerate(near):
                    enough = int(np.searchsorted(np.cumsum(sizes[order]), 4 * k)) + 1
                    order = order[: max(int(np.ceil(probes * len(order))), enough)]
                    where = cell_of[order]
                    for c in np.unique(where):
                        mine = order[where == c]
                        for b in range(blocks[mine[0]]):
                            row.append(i)
                            cell.append(int(c) + b)
                            lists.append(mine)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *(c.take(pa.array(row, pa.int64())) for c in some.columns), pa.array(lists, pa.list_(pa.int32()))], names=["cell", "kind", "embedding", "lists"])

    asked = kinds.select("kind", "embedding").mapInArrow(tidied(choose), "cell bigint, kind bigint, embedding array<double>, lists array<int>")
    turns = F.array(*(F.lit(int(b)) for b in blocks))
    bases = F.array(*(F.lit(int(c)) for c in cell_of))
    at = F.col("list") + 1
    place = F.element_at(bases, at) + F.pmod(F.xxhash64("vec_id"), F.element_at(turns, at).cast("bigint"))
    stored = indexed.select(place.cast("bigint").alias("cell"), "list", "vec_id", "embedding")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell and wave, a cell's vectors before its queries."""
        key, held, cell = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            cells, waves, asked = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "wave", "asked"))
            head = np.flatnonzero(np.r_[True, (np.diff(cells) != 0) | (np.diff(waves) != 0) | (np.diff(asked) != 0)])
            for a, b in zip(head, [*head[1:], len(batch)], strict=True):
                some = batch.slice(a, b - a)
                if (cells[a], waves[a]) != key:
                    key, held, cell = (cells[a], waves[a]), [], None
                if not asked[a]:
                    held.append((some.column("id").to_numpy(), _matrix(some.column("embedding"), d), some.column("list").to_numpy()))
                    continue
                if held:
                    ids, m, lists = (np.concatenate(x) for x in zip(*held, strict=True))
                    keep, held = _folded(ids, m, k + 1), []
                    cell = Cell(ids[keep], m[keep], lists[keep], sent.value[1], top)
                for part in (some.slice(x, 1024) for x in range(0, len(some), 1024) if cell is not None):
                    yield scanned(cell, part)

    def scanned(cell: Cell, part: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], []]
        qs = _matrix(part.column("embedding"), d)
        lists = [np.asarray(x) for x in part.column("lists").to_pylist()]
        for kind, v, found in zip(part.column("id").to_pylist(), qs, cell.near(qs, lists, k + 1), strict=True):
            score = (cell.x[found] * v).sum(1)
            best = np.lexsort((cell.ids[found], -score))[: k + 1]
            out[0].append(np.full(len(best), kind))
            out[1].append(cell.ids[found][best])
            out[2].append(score[best])
        whole = [np.concatenate(c) for c in out]
        return pa.RecordBatch.from_arrays([pa.array(whole[0].astype(np.int64)), pa.array(whole[1].astype(np.int64)), pa.array(whole[2].astype(np.float64))], names=["kind", "vec_id", "score"])

    waves = max(1, -(-int(kinds.count()) // wave))
    null_lists, no_list = F.lit(None).cast("array<int>"), F.lit(None).cast("int")
    scans = asked.select("cell", F.pmod(F.xxhash64("kind"), F.lit(waves)).cast("bigint").alias("wave"), F.lit(True).alias("asked"), F.col("kind").alias("id"), no_list.alias("list"), "lists", "embedding")
    every = F.explode(F.sequence(F.lit(0), F.lit(waves - 1)).cast("array<bigint>")) if waves > 1 else F.lit(0).cast("bigint")
    stored = stored.select("cell", every.alias("wave"), F.lit(False).alias("asked"), F.col("vec_id").alias("id"), "list", null_lists.alias("lists"), "embedding")
    # several partitions for each cell and wave, so that few of them meet in one
    parts = int(min(4 * (cells + 1) * waves, max(1_000, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    dealt = stored.unionByName(scans).repartition(parts, "cell", "wave").sortWithinPartitions("cell", "wave", "asked")
    hits = dealt.mapInArrow(tidied(look), "kind bigint, vec_id bigint, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    top_of = hits.groupBy("kind", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("place") <= k + 1).drop("place")
    names = kinds.withColumnRenamed("embedding", "of")
    members = q.join(names, F.col("embedding") == F.col("of")).select(F.col("vec_id").alias("query_id"), "kind").distinct()
    pairs = members.join(top_of, "kind").where("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
