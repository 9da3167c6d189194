"""Map projections as column expressions, after Snyder, USGS PP 1395.

EPSG:6933 is the ellipsoidal cylindrical equal-area projection with standard parallel
30 degrees; EPSG:32736 is the transverse Mercator of UTM zone 36 south.  Both on WGS84.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)


def _q(s):
    """Snyder's q of sin(latitude); works on floats and columns alike."""
    log = math.log if isinstance(s, float) else F.log
    return (1 - E2) * (s / (1 - E2 * s * s) - log((1 - E * s) / (1 + E * s)) / (2 * E))


QP = _q(1.0)


def cea_x(lon: Column) -> Column:
    return F.lit(A * K0) * F.radians(lon)


def cea_y(lat: Column) -> Column:
    return F.lit(A) * _q(F.sin(F.radians(lat))) / F.lit(2 * K0)


def cea_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(A * K0))


def cea_lat(y: Column) -> Column:
    beta = F.asin(y * F.lit(2 * K0 / (A * QP)))
    c2 = E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040
    c4 = 23 * E2**2 / 360 + 251 * E2**3 / 3780
    c6 = 761 * E2**3 / 45360
    return F.degrees(beta + F.lit(c2) * F.sin(2 * beta) + F.lit(c4) * F.sin(4 * beta) + F.lit(c6) * F.sin(6 * beta))


def cea_point(lon: float, lat: float) -> tuple[float, float]:
    """The projected point of a place, on the driver."""
    return A * K0 * math.radians(lon), A * _q(math.sin(math.radians(lat))) / (2 * K0)


def utm_xy(lon: Column, lat: Column, zone: int = 36, south: bool = True) -> tuple[Column, Column]:
    """(x, y) of a place in UTM coordinates, by the forward series (Snyder 8-9 to 8-15)."""
    ep2 = E2 / (1 - E2)
    p = F.radians(lat)
    s, c, t = F.sin(p), F.cos(p), F.pow(F.tan(p), F.lit(2.0))
    c1 = F.lit(ep2) * c * c
    n = F.lit(A) / F.sqrt(F.lit(1.0) - F.lit(E2) * s * s)
    a = F.radians(lon - F.lit(float(6 * zone - 183))) * c
    m0, m2, m4, m6 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024, 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072
    m = F.lit(A) * (F.lit(m0) * p - F.lit(m2) * F.sin(2 * p) + F.lit(m4) * F.sin(4 * p) - F.lit(m6) * F.sin(6 * p))
    east = n * (a + (1 - t + c1) * F.pow(a, F.lit(3.0)) / 6 + (5 - 18 * t + t * t + 72 * c1 - 58 * ep2) * F.pow(a, F.lit(5.0)) / 120)
    north = m + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * c1 + 4 * c1 * c1) * F.pow(a, F.lit(4.0)) / 24 + (61 - 58 * t + t * t + 600 * c1 - 330 * ep2) * F.pow(a, F.lit(6.0)) / 720)
    return F.lit(500_000.0) + F.lit(0.9996) * east, F.lit(10_000_000.0 if south else 0.0) + F.lit(0.9996) * north


def utm_latlon(x: Column, y: Column, zone: int = 36, south: bool = True) -> tuple[Column, Column]:
    """(latitude, longitude) of UTM coordinates, by the inverse series."""
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    ep2 = E2 / (1 - E2)
    m = (y - F.lit(10_000_000.0 if south else 0.0)) / F.lit(0.9996)
    mu = m / F.lit(A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    p = mu + F.lit(3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + F.lit(21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + F.lit(151 * e1**3 / 96) * F.sin(6 * mu) + F.lit(1097 * e1**4 / 512) * F.sin(8 * mu)
    s, c, t = F.sin(p), F.cos(p), F.pow(F.tan(p), F.lit(2.0))
    c1 = F.lit(ep2) * c * c
    root = F.lit(1.0) - F.lit(E2) * s * s
    n1 = F.lit(A) / F.sqrt(root)
    r1 = F.lit(A * (1 - E2)) / (root * F.sqrt(root))
    d = (x - F.lit(500_000.0)) / (n1 * F.lit(0.9996))
    lat = p - (n1 * F.tan(p) / r1) * (d * d / 2 - (5 + 3 * t + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * F.pow(d, F.lit(4.0)) / 24 + (61 + 90 * t + 298 * c1 + 45 * t * t - 252 * ep2 - 3 * c1 * c1) * F.pow(d, F.lit(6.0)) / 720)
    lon = (d - (1 + 2 * t + c1) * F.pow(d, F.lit(3.0)) / 6 + (5 - 2 * c1 + 28 * t - 3 * c1 * c1 + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5.0)) / 120) / c
    return F.degrees(lat), F.lit(float(6 * zone - 183)) + F.degrees(lon)
