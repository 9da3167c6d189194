"""Classification of pixels from their signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.cases import CASES, classify
from pixelloom.functions.indices import evidence_confidence


def screen(df: DataFrame, z_ndvi: str = "z_ndvi", z_r: str = "z_r", delta: str = "delta_swi_14d", swi: str | None = "swi", swi_enabled: bool = True) -> DataFrame:
    """M7, M8: ``df`` with diagnostic_case and evidence_confidence."""
    case = classify(F.col(z_ndvi), F.col(z_r), F.col(delta), F.col(swi) if swi else None, swi_enabled)
    return df.withColumns({"diagnostic_case": case, "evidence_confidence": evidence_confidence(F.col(z_ndvi), F.col(z_r), F.col(delta))})


#: The columns of a bin's class counts.
COUNTS = {0: "normal_pixels", 1: "case_a_pixels", 2: "case_b_pixels", 3: "case_c_pixels", 4: "case_d_pixels", 5: "multi_signal_pixels", -1: "insufficient_evidence_pixels"}


def class_histogram(df: DataFrame, keys: Sequence[str] = ("bin",), case: str = "diagnostic_case") -> DataFrame:
    """Counts of every class, zeros too."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(case) == code).cast("int").alias(name) for code, name in COUNTS.items()))


def with_dominant(hist: DataFrame, out: str = "dominant_case") -> DataFrame:
    """The largest of B, D, MULTI and A, ties in that order; NORMAL if all are 0."""
    order = (2, 4, 5, 1)
    top = F.greatest(*(F.col(COUNTS[c]) for c in order))
    pick = F.when(top == 0, CASES[0])
    for c in order:
        pick = pick.when(F.col(COUNTS[c]) == top, CASES[c])
    return hist.withColumn(out, pick)
