"""Exact deduplication by Patricia-trie owners.

Texts are equal when their bytes are equal after deleting ``[\\x20\\x09-\\x0D]``.  Every
input partition inserts its texts into compressed radix tries, one trie for each
(length, content hash), whose terminal nodes hold the group's owner so far; so a text
that a third of all rows share leaves each partition once.  The distinct byte strings
are then dealt out by (length, content hash), sorted, and inserted into tries again,
one key at a time.  Tries that outgrow their memory hand on their largest subtrees as
partial groups, down to half the limit, and a last aggregation merges those; no row is
dropped and nothing is written to local disk.

Results for odd input: a null text counts as empty, and all empty texts are one group;
a null ``doc_id`` loses ties against any other and owns a group only if the group has no
other id; rows that repeat a doc_id are the same document, all of them kept or none;
other columns are ignored, whatever their names; an empty table gives no rows; ids are cast
to bigint, and a string that is no integer raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.sieve import columns_of, fresh, sieve, sift
from pixelloom.llm.tokens import tidied
from pixelloom.session import materialize

TRIE_BYTES = 32 << 20  # bytes of tries a task holds before it spills subtrees
NODE_BYTES = 400  # what a node takes besides its label

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


class Node:
    """A node of a compressed radix trie: edge label, children by first byte, group or None."""

    __slots__ = ("group", "kids", "label")

    def __init__(self, label: bytes, group: list | None = None):
        self.label, self.group, self.kids = label, group, {}


def better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, doc_id): more code points, then the smaller doc_id, null last."""
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    if a[1] is None or b[1] is None:
        return b if a[1] is None else a
    return a if a[1] <= b[1] else b


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Trie:
    """Owners of byte strings: insert() merges a group into its terminal node.

    size: bytes of the labels, and NODE_BYTES for each node.
    """

    def __init__(self):
        self.root, self.size = Node(b""), NODE_BYTES

    @property
    def empty(self) -> bool:
        return not self.root.kids and self.root.group is None

    def insert(self, text: bytes, owner: tuple, count: int) -> None:
        node, rest = self.root, text
        while True:
            if not rest:
                if node.group is None:
                    node.group = [owner, count]
                else:
                    node.group = [better(node.group[0], owner), node.group[1] + count]
                return
            kid = node.kids.get(rest[0])
            if kid is None:
                node.kids[rest[0]] = Node(rest, [owner, count])
                self.size += len(rest) + NODE_BYTES
                return
            n = _shared(kid.label, rest)
            if n < len(kid.label):
                upper = Node(kid.label[:n])
                upper.kids[kid.label[n]] = kid
                kid.label = kid.label[n:]
                node.kids[rest[0]] = kid = upper
                self.size += NODE_BYTES
            node, rest = kid, rest[n:]

    def groups(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, before = stack.pop()
            whole = before + node.label
            if node.group is not None:
                yield whole, *node.group
            stack.extend((kid, whole) for kid in node.kids.values())

    def spill(self, target: int) -> Iterator[tuple[bytes, tuple, int]]:
        """Hand on and forget subtrees under the first branching node, the largest first,
        until the trie's size is at most ``target``; the whole trie if that is not enough."""
        node, prefix = self.root, b""
        while len(node.kids) == 1 and node.group is None:
            node, prefix = next(iter(node.kids.values())), prefix + node.label
        prefix += node.label
        sizes = {}
        for first, kid in node.kids.items():
            stack, total = [kid], 0
            while stack:
                x = stack.pop()
                total += len(x.label) + NODE_BYTES
                stack.extend(x.kids.values())
            sizes[first] = total
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= target:
                return
            yield from self.groups(node.kids.pop(first), prefix)
            self.size -= sizes[first]
        if self.size > target:
            yield from self.groups()
            self.root, self.size = Node(b""), NODE_BYTES


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


_PART = "n_bytes bigint, content_hash bigint, norm binary, n_points bigint, doc_id bigint, n bigint"
_ARROW = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("norm", pa.binary()), ("n_points", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])


def _owners(limit: int, in_order: bool):
    """A mapInArrow function that replaces rows of equal bytes by one row with the owner.

    in_order: rows come sorted by key, so each key's trie is done when the next begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple, Trie] = {}
        held, rows = 0, []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            return out

        def give(key, groups) -> Iterator[pa.RecordBatch]:
            filled = 0
            for text, owner, n in groups:
                rows.append((*key, text, *owner, n))
                filled += len(text)
                if filled > 4 << 20 or len(rows) >= 4096:
                    filled = 0
                    yield batch()

        last = None
        for b in batches:
            columns = [b.column(i) for i in range(6)]
            for size, code, text, points, doc, n in zip(*(c.to_pylist() if c.type != pa.binary() else c for c in columns), strict=True):
                key, text = (size, code), text.as_py()
                if in_order and last is not None and key != last:
                    if last in tries:
                        yield from give(last, tries.pop(last).groups())
                    held = 0
                last = key
                trie = tries.get(key)
                before = trie.size if trie else 0
                if trie is None:
                    trie = tries[key] = Trie()
                trie.insert(text, (points, doc), n)
                held += trie.size - before
                if held <= limit:
                    continue
                # half of it goes at once, so that each byte is looked at a bounded number of times
                for most in sorted(tries, key=lambda k: tries[k].size, reverse=True):
                    if held <= limit // 2:
                        break
                    before = tries[most].size
                    yield from give(most, tries[most].spill(max(0, before - (held - limit // 2))))
                    held -= before - tries[most].size
                    if tries[most].empty:
                        held -= tries.pop(most).size
            if rows and in_order:
                yield batch()
        for key, trie in tries.items():
            yield from give(key, trie.groups())
        if rows:
            yield batch()

    return run


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per group of equal texts: text_sha256, keep_id, group_size."""
    norm = normalised(F.col("text"))
    rows = docs.select(norm.alias("norm"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_points"), F.col("doc_id").cast("bigint").alias("doc_id"))
    rows = rows.select(F.octet_length("norm").cast("bigint").alias("n_bytes"), F.xxhash64("norm").alias("content_hash"), F.col("norm").cast("binary").alias("norm"), "n_points", "doc_id", F.lit(1).cast("bigint").alias("n"))
    local = rows.mapInArrow(tidied(_owners(trie_bytes, False)), _PART)
    dealt = local.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    parts = dealt.mapInArrow(tidied(_owners(trie_bytes, True)), _PART).select(F.sha2("norm", 256).alias("text_sha256"), "n_points", "doc_id", "n")
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    return parts.groupBy("text_sha256").agg(best.alias("best"), F.sum("n").alias("group_size")).select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    shared = materialize(owners(docs, trie_bytes).where("group_size > 1"), "owners").withColumnRenamed("text_sha256", "sha")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    found = rows.join(shared, F.col("text_sha256") == F.col("sha"), "left")
    keep = F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_owners(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that own their group, one for each group and every column kept.

    Rows that repeat both the owner's id and its text are one document and stay together.
    """
    sha, keep, own = fresh(docs, "sha", "keep", "own")
    shared = materialize(owners(docs).where("group_size > 1"), "owners").select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep))
    rows = docs.withColumn(own, F.sha2(normalised(F.col("text")).cast("binary"), 256))
    maybe, single = sift(rows, sieve(shared, sha), F.col(own))  # texts that occur once need not move
    found = maybe.join(shared, F.col(own) == F.col(sha), "left")
    kept = found.where(F.col(sha).isNull() | F.col("doc_id").cast("bigint").eqNullSafe(F.col(keep)))
    return single.select(*columns_of(docs)).unionByName(kept.select(*columns_of(docs)))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
