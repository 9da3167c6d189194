"""A bounded sieve before joins that would otherwise move every wide row.

The keys to look for set bits of a table of 2**18 words, 64 bits each, whatever their
number, so the table may be broadcast.  Rows whose bit is not set certainly have no such
key and need not move; the others go on to the exact join.  The more keys, the more rows
pass; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.session import files_for, materialize

WORD_BITS = 18


def fresh(rows: DataFrame, *stems: str) -> list[str]:
    """Names made of ``stems`` that no column of ``rows`` has, in whatever case."""
    used, out = {c.lower() for c in rows.columns}, []
    for stem in stems:
        name = "_" + stem
        while name in used:
            name = "_" + name
        used.add(name)
        out.append(name)
    return out


def columns_of(rows: DataFrame) -> list[Column]:
    """The columns of ``rows``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]


def _word(mark: Column) -> Column:
    return F.shiftrightunsigned(mark, 64 - WORD_BITS)


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): at most 2**WORD_BITS rows.  keys: a written table, since they are counted too."""
    marks = keys.select(F.xxhash64(key).alias("mark"))
    bits = F.expr("bit_or(shiftleft(1L, cast(mark & 63 as int)))")
    return materialize(marks.groupBy(_word(F.col("mark")).alias("word")).agg(bits.alias("bits")), "sieve", files_for(min(keys.count(), 1 << WORD_BITS)))


def sift(rows: DataFrame, words: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that have none)."""
    mark, word, bits = fresh(rows, "mark", "word", "bits")
    marked = rows.withColumn(mark, F.xxhash64(key)).withColumn(word, _word(F.col(mark)))
    joined = marked.join(F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits))), word, "left")
    place = (F.col(mark).bitwiseAND(63)).cast("int")
    bit = F.coalesce(F.call_function("shiftright", F.col(bits), place).bitwiseAND(1), F.lit(0).cast("bigint")) == 1
    return joined.where(bit).select(*columns_of(rows)), joined.where(~bit).select(*columns_of(rows))
