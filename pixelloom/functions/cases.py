"""The diagnostic cases of a pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case codes and the cases that call for scouting.
CASES = {-1: "INSUFFICIENT_EVIDENCE", 0: "NORMAL", 1: "CASE_A", 2: "CASE_B", 3: "CASE_C", 4: "CASE_D", 5: "MULTI_SIGNAL"}
ACTIONABLE = (1, 2, 4, 5)


def _f(value: float) -> Column:
    """Thresholds compare as 32-bit floats, like the values."""
    return F.lit(value).cast("float")


def classify(z_ndvi: Column, z_r: Column, delta: Column, swi: Column | None = None, swi_enabled: bool = True) -> Column:
    """The case of a pixel; missing evidence never reads as normal.

    swi: without it, or with ``swi_enabled`` off, cases B and C never hold.
    """
    z_ndvi, z_r, delta = (x.cast("float") for x in (z_ndvi, z_r, delta))
    no = F.lit(False)
    a = F.coalesce((z_r < _f(-0.8)) & (z_ndvi < _f(-1.0)), no)
    b = c = no
    if swi is not None and swi_enabled:
        wet = swi.cast("float") >= _f(0.30)
        b = F.coalesce((z_r >= _f(0.0)) & (z_ndvi < _f(-1.2)) & wet, no)
        c = F.coalesce((z_r < _f(-1.0)) & (z_ndvi >= _f(-0.5)) & wet, no)
    d = F.coalesce((z_r >= _f(0.5)) & (delta <= _f(0.0)), no)
    fired = sum((x.cast("int") for x in (a, b, c, d)), F.lit(0))
    evidence = z_r.isNotNull() & (z_ndvi.isNotNull() | delta.isNotNull())
    out = F.when(fired >= 2, 5).when(a, 1).when(b, 2).when(c, 3).when(d, 4).when(evidence, 0).otherwise(-1)
    return out.cast("tinyint")


def actionable(case: Column) -> Column:
    return case.isin(*ACTIONABLE)


def case_name(case: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for code, name in CASES.items() for x in (code, name))), case.cast("int"))
