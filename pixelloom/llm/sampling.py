"""Bounded samples by hash order, with a bound on what any task or the driver gathers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below(mark: Column, share: float) -> Column:
    """Whether a 64-bit hash lies among the smallest ``share`` of all hashes."""
    if share >= 1:
        return F.lit(True)
    return mark < F.lit(int(-(2**63) + share * 2**64))


def hash_sample(rows: DataFrame, key: list[str], n: int, total: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes of ``key``, one for each hash.

    total: how many rows there are.  Rows beyond the hash that about 1.5 * n of them lie
    below are left out by a filter, so partitions hand on few rows however many they are.
    """
    mark = F.xxhash64(*key)
    share = (1.5 * n + 100) / max(total, 1)
    some = rows.where(below(mark, share)).withColumn("_mark", mark).dropDuplicates(["_mark"])
    return some.orderBy("_mark").limit(n).drop("_mark")
