"""Distributed connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.session import files_for, free, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its larger neighbours to the smallest vertex it knows."""
    both = _both_ways(edges)
    low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands itself and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(low, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(low.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40, most: int | None = None) -> DataFrame:
    """(id, component): the smallest vertex reachable from each vertex that has an edge.

    ``edges``: (src, dst) of any one orderable type; nulls, loops and repeats are ignored.
    most: how many there are at most, if that is known; it only bounds the files written.
    Alternating large-star and small-star rounds: edges never outgrow their first number,
    rounds grow with the logarithm of a component's size, aggregates combine before the
    shuffle and joins on a vertex of high degree are split by adaptive execution.
    """
    pairs = edges.where("src is not null and dst is not null and src <> dst")
    now = materialize(pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges", None if most is None else files_for(most))
    mark = None
    for _ in range(max_rounds):
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if not row["n"] or (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
        before, now = now, materialize(_small_star(_large_star(now)), "edges", files_for(row["n"]))
        free(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
