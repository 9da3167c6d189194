"""Spectral indices and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1e-4
EPSILON = 1e-6
STD_FLOOR = 1e-4


def known(value: Column) -> Column:
    """The value with NaN as null: every source passes its floats through this."""
    return F.when(~F.isnan(value), value)


def reflectance(df: DataFrame, band: str, scale: float = SCALE, has_scale: bool = False) -> Column:
    """Reflectance of a band (P8): integers times ``scale``; floats as they are, but floats
    marked ``has_scale`` whose largest value is over 1.5 times ``scale`` as well."""
    kind = df.schema[band].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(band).cast("double") * scale
    if has_scale:
        top = df.select(F.max(known(F.col(band)))).scalar()
        return F.when(top > 1.5, F.col(band) * scale).otherwise(F.col(band))
    return F.col(band).cast("double")


def normalised_difference(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """(a - b) / (a + b + epsilon); null where that sum is 0."""
    below = a + b + F.lit(epsilon)
    return F.when(below != 0, (a - b) / below)


def ndvi(red: Column, nir: Column, epsilon: float = EPSILON) -> Column:
    """M1; not clamped."""
    return normalised_difference(nir, red, epsilon)


def evi(blue: Column, red: Column, nir: Column, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, soil: float = 1.0, epsilon: float = EPSILON) -> Column:
    """M2: a denominator of exactly 0 becomes ``epsilon``, a null one stays null."""
    below = nir + F.lit(c1) * red - F.lit(c2) * blue + F.lit(soil)
    return F.lit(gain) * (nir - red) / F.when(below == 0, F.lit(epsilon)).otherwise(below)


def standardised(value: Column, mean: Column, std: Column, floor: float = STD_FLOOR) -> Column:
    """M5, M6: null where the standard deviation is null or no more than ``floor``."""
    return F.when(std > floor, (value - mean) / std)


def evidence_confidence(*layers: Column) -> Column:
    """M8: the share of layers that are not null, as a 32-bit float."""
    if not layers:
        raise ValueError("at least one layer is needed")
    present = sum((x.isNotNull().cast("int") for x in layers), F.lit(0))
    return (present / F.lit(len(layers))).cast("float")
