"""Areas of interest."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def validate_bbox(bbox: Sequence[float]) -> tuple[float, float, float, float]:
    """P12."""
    if len(bbox) != 4:
        raise ValueError("a box has four numbers")
    x0, y0, x1, y1 = (float(v) for v in bbox)
    if not (-180 <= x0 <= 180 and -180 <= x1 <= 180 and -90 <= y0 <= 90 and -90 <= y1 <= 90):
        raise ValueError(f"{bbox} leaves the globe")
    if x0 >= x1 or y0 >= y1:
        raise ValueError(f"{bbox} has no area")
    return x0, y0, x1, y1


def bbox_problem(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """P12 for boxes in columns: what is wrong with a box, null if nothing is."""
    inside = x0.between(-180, 180) & x1.between(-180, 180) & y0.between(-90, 90) & y1.between(-90, 90)
    return F.when(x0.isNull() | y0.isNull() | x1.isNull() | y1.isNull(), "null").when(~inside, "range").when((x0 >= x1) | (y0 >= y1), "order")


def bbox_ring(bbox: Sequence[float]) -> list[list[float]]:
    """The box's ring, counter-clockwise."""
    x0, y0, x1, y1 = validate_bbox(bbox)
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def _area(ring: Sequence[Sequence[float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _crosses(a, b, c, d) -> bool:
    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def rings_of(geometry) -> list[list[list[float]]]:
    """The outer rings of a box, FeatureCollection (its first feature), Feature or geometry; raises if not valid."""
    if isinstance(geometry, list | tuple):
        return [bbox_ring(geometry)]
    if not isinstance(geometry, Mapping):
        raise ValueError("no geometry")
    kind = geometry.get("type")
    if kind == "FeatureCollection":
        if not geometry.get("features"):
            raise ValueError("no features")
        return rings_of(geometry["features"][0])
    if kind == "Feature":
        return rings_of(geometry.get("geometry"))
    if kind == "Polygon":
        rings = [geometry["coordinates"][0]] if geometry.get("coordinates") else []
    elif kind == "MultiPolygon":
        rings = [p[0] for p in geometry.get("coordinates", [])]
    else:
        raise ValueError(f"{kind} is no area")
    if not rings:
        raise ValueError("the geometry is empty")
    for ring in rings:
        if len(ring) < 4 or ring[0] != ring[-1] or _area(ring) == 0:
            raise ValueError("a ring is not closed or has no area")
        edges = list(zip(ring, ring[1:], strict=False))
        if any(_crosses(*e, *f) for i, e in enumerate(edges) for f in edges[i + 2 :]):
            raise ValueError("a ring crosses itself")
    return rings


def overlaps(x0: Column, y0: Column, x1: Column, y1: Column, bbox: Sequence[float], buffer: float = 0.05) -> Column:
    """P15, J10 for boxes in columns: whether they meet the box grown by ``buffer``, edges included."""
    a, b, c, d = bbox[0] - buffer, bbox[1] - buffer, bbox[2] + buffer, bbox[3] + buffer
    return (x0 <= c) & (x1 >= a) & (y0 <= d) & (y1 >= b)


def _inside(point, ring) -> bool:
    x, y = point
    hit = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


def meets(geometry, bbox: Sequence[float], buffer: float = 0.05) -> bool:
    """P15 on the driver: whether an area meets the grown box."""
    box = [[bbox[0] - buffer, bbox[1] - buffer], [bbox[2] + buffer, bbox[1] - buffer], [bbox[2] + buffer, bbox[3] + buffer], [bbox[0] - buffer, bbox[3] + buffer]]
    box.append(box[0])
    for ring in rings_of(geometry):
        if any(box[0][0] <= x <= box[2][0] and box[0][1] <= y <= box[2][1] for x, y in ring) or any(_inside(p, ring) for p in box):
            return True
        if any(_crosses(*e, *f) for e in zip(ring, ring[1:], strict=False) for f in zip(box, box[1:], strict=False)):
            return True
    return False


def load_aoi(path: str) -> list[list[list[float]]]:
    """The rings of a GeoJSON file; a relative path is looked up here, then beside the package."""
    for base in ("", os.getcwd(), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))):
        full = os.path.join(base, path)
        if os.path.exists(full):
            with open(full, encoding="utf-8") as f:
                return rings_of(json.load(f))
    raise FileNotFoundError(path)


def load_config(path: str) -> dict:
    """I16: a mapping from a JSON file, or from YAML where a reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        yaml = None
    found = yaml.safe_load(text) if yaml and not path.endswith(".json") else json.loads(text or "null")
    if not isinstance(found, dict) or not found:
        raise ValueError(f"{path} holds no mapping")
    return found
