"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import ann, bpe, exact_dedup, lm_score, near_dedup, packing, passages, secrets, toxicity, url_filter
from pixelloom.session import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _bounded(f: Query) -> Query:
    """The query with small Arrow batches, since texts and sets can be wide."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_lm_score": lm_score.op1_lm_score,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_packing": packing.op3_packing,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_url_filter": url_filter.op6_url_filter,
        "url_alias_verdicts": url_filter.url_alias_verdicts,
        "op7_near_passages": passages.op7_near_passages,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_ann": ann.op10_ann,
    }
    return {name: _bounded(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": url_filter.OP6_SQL,
        "url_alias_verdicts": url_filter.ALIAS_SQL,
        "op8_near_dedup": near_dedup.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
    }
