"""The corpus pipeline: toxicity, exact dedup, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last keep the columns
of ``documents``.

* toxicity: documents with a score of at least 0.7 go; the model learns from ``labels``.
* exact_dedup: of texts that are equal but for white space one document stays.
* near_dedup: of documents that five-word shingles of similarity 0.8 or more link, one stays.
* secrets: every secret found is replaced by ``[SECRET]``; documents stay.
* packing: token sequences of at most 1024, a row for each piece.

Nulls, empty texts, repeated rows and empty tables have the results that the operators
state; an empty table passes through every stage.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import exact_dedup, near_dedup, packing, toxicity
from pixelloom.llm import secrets as secret_scan
from pixelloom.session import free, materialize, small_batches


def bounded(stage):
    """The stage with small Arrow batches, since texts and sets can be wide."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark, "4m")
        return stage(spark, docs, sf_dir)

    return run


@bounded
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@bounded
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_owners(docs)


@bounded
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


@bounded
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.fit_field(docs))


@bounded
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

# Trained models decide two stages; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
