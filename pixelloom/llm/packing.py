"""Packing by concatenate and cut.

All documents' ids, each followed by an end id, are one long run that is cut every
``width`` ids.  Pass one encodes every partition, adds up ids within it and writes ids
and local starts to the shared folder; prefix sums over the partitions' totals, a few
numbers for each partition, give each partition's global offset.  Pass two cuts every
document at the multiples of ``width`` that fall into it; each piece is a boundary
record.  Only the last sequence can be short, so padding is under ``width`` ids in all.

Results for odd input: a null or empty text is its end id alone; repeated rows are packed
as often as they occur; a null doc_id is carried along; other columns are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.bpe import encoder_of, model_json
from pixelloom.llm.tokens import tidied
from pixelloom.session import materialize

WIDTH = 1024
END = 0


def token_runs(docs: DataFrame, path: str, pattern: str, end: int = END) -> DataFrame:
    """Pass one: (part, local_start, doc_id, n, ids, wide) of every document, written out.

    ids: little-endian, 16 bits each, or 32 where ``wide``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = encoder_of(sent.value, pattern), TaskContext.get().partitionId(), 0
        wide = coder.dtype.itemsize == 4 or end >= 1 << 16
        last = np.array([end], "<u4" if wide else "<u2").tobytes()
        for batch in batches:
            for rows in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                starts, counts, runs = [], [], []
                for x in rows.column(1):
                    packed = coder.packed(x.as_py() or "")
                    n = len(packed) // 4 + 1
                    starts.append(at)
                    counts.append(n)
                    runs.append((packed if wide else np.frombuffer(packed, "<u4").astype("<u2").tobytes()) + last)
                    at += n
                size = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * size, pa.int32()), pa.array(starts, pa.int64()), rows.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.binary()), pa.array([wide] * size, pa.bool_())],
                    names=["part", "local_start", "doc_id", "n", "ids", "wide"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = docs.select("doc_id", "text").mapInArrow(tidied(run), f"part int, local_start bigint, doc_id {kind}, n bigint, ids binary, wide boolean")
    return materialize(runs, "ids")


def cut(runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pass two: the boundary records of all pieces."""
    totals = runs.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = runs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n", "ids", "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, at, n, ids, wide in zip(*(batch.column(i).to_pylist() if i != 3 else batch.column(i) for i in range(5)), strict=True):
                ids = ids.as_py()
                if not wide:
                    ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                a = 0
                while a < n:
                    b = min(n, a + width - (at + a) % width)
                    for c, x in zip(out, (doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n, (at + a) // width, (at + a) % width), strict=True):
                        c.append(x)
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in out[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = runs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(tidied(run), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, pattern: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    return cut(token_runs(docs, path, pattern, end), width)


def sequences(runs: DataFrame, pieces: DataFrame, width: int = WIDTH, pad: int = END) -> DataFrame:
    """(sequence_id, ids, n): the packed sequences themselves, padded to ``width`` except at a power of two.

    runs and pieces as of token_runs() and cut(); doc_id must be unique.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["sequence_id", "offset", "start", "length", "ids", "wide"]
            seq, off, start, length, ids, wide = (batch.column(k).to_pylist() for k in names)
            cuts = [np.frombuffer(i, "<u4" if w else "<u2")[s : s + k].astype(np.int32) for i, w, s, k in zip(ids, wide, start, length, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(cuts, pa.list_(pa.int32()))], names=["sequence_id", "offset", "part"])

    joined = pieces.join(runs.select("doc_id", "ids", "wide"), "doc_id")
    parts = joined.mapInArrow(tidied(run), "sequence_id bigint, offset bigint, part array<int>")
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))  # at most width pieces
    ids = F.flatten("parts.part")
    size = F.size("ids")
    whole = whole.select("sequence_id", ids.alias("ids")).withColumn("n", size)
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return whole.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.lit(width) - F.col("n")))).alias("ids"), "n")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
