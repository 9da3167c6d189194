"""Zones of flagged pixels.

A mask is a table of flagged cells (bin, row, col).  Opening is done by counting
neighbours; labelling runs per tile of ``TILE`` cells a side, and labels that touch over a
tile's border are merged by distributed label propagation, so no bin has to fit a task.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.cases import case_name
from pixelloom.functions.projection import cea_lat, cea_lon
from pixelloom.session import materialize

TILE = 512
MMU_M2 = 20_000.0
PIXEL_M2 = 900.0


def _around(df: DataFrame) -> DataFrame:
    """Every cell and its eight neighbours."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return df.select("bin", "row", "col", F.explode(steps).alias("d")).select("bin", (F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col"))


def erode(mask: DataFrame) -> DataFrame:
    """Cells with all nine of their neighbourhood flagged; outside of the grid nothing is."""
    return _around(mask).groupBy("bin", "row", "col").agg(F.count(F.lit(1)).alias("n")).where("n = 9").select("bin", "row", "col")


def dilate(mask: DataFrame) -> DataFrame:
    return _around(mask).distinct()


def opening(mask: DataFrame) -> DataFrame:
    """Erosion, then dilation; what dilates lies within the mask again."""
    return dilate(erode(mask.select("bin", "row", "col").distinct()))


def _tile_labels(tile: int):
    """Labels of one tile: runs along rows, united where they touch, by arrays."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy() for x in ("row", "col"))
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        head = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)])
        tail = np.r_[head[1:], len(r)] - 1
        rows, start, end = r[head], c[head], c[tail]
        # a run touches those of the row before that begin no later than its end + 1 and end no sooner than its start - 1
        width = np.int64(end.max() - start.min() + 4)
        place = lambda row, col: (row - r[0]) * width + (col - start.min() + 1)
        first = np.searchsorted(place(rows, end), place(rows - 1, start - 1), "left")
        last = np.searchsorted(place(rows, start), place(rows - 1, end + 1), "right")
        many = np.maximum(last - first, 0)
        x = np.repeat(np.arange(len(head)), many)
        y = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        label = np.arange(len(head))
        while True:
            low = label.copy()
            np.minimum.at(low, label[x], label[y])
            np.minimum.at(low, label[y], label[x])
            while (low[low] != low).any():
                low = low[low]
            low = low[label]
            if (low == label).all():
                break
            label = low
        part = ((rows << 32) + start)[label]
        out = np.repeat(part, tail - head + 1)
        return pa.table([pa.array(np.full(len(r), key[0].as_py(), np.int64)), pa.array(r), pa.array(c), pa.array(out)], names=["bin", "row", "col", "part"])

    return run


def label_components(mask: DataFrame, tile: int = TILE, max_rounds: int = 60) -> DataFrame:
    """(bin, row, col, comp_id): 8-connected components, numbered from 1 by their first cell in raster order."""
    cells = mask.select(F.col("bin").cast("bigint").alias("bin"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")).distinct()
    placed = cells.withColumn("ty", F.floor(F.col("row") / tile)).withColumn("tx", F.floor(F.col("col") / tile))
    labelled = materialize(placed.groupBy("bin", "ty", "tx").applyInArrow(_tile_labels(tile), "bin bigint, row bigint, col bigint, part bigint"), "labels")

    # edges between parts of neighbouring tiles, from the cells along the borders
    border = labelled.where((F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1)))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))))
    there = border.select("bin", F.col("part").alias("x"), F.explode(steps).alias("d"), "row", "col").select("bin", "x", (F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col"))
    edges = there.join(border, ["bin", "row", "col"]).where("x <> part").select("bin", "x", F.col("part").alias("y")).distinct()
    edges = materialize(edges.unionByName(edges.select("bin", F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "borders")
    names = labelled.select("bin", "part").distinct().withColumn("root", F.col("part"))
    if not edges.isEmpty():
        for _ in range(max_rounds):
            low = edges.join(names.withColumnRenamed("part", "y"), ["bin", "y"]).groupBy("bin", F.col("x").alias("part")).agg(F.min("root").alias("low"))
            step = names.join(low, ["bin", "part"], "left").select("bin", "part", F.least("root", F.coalesce("low", "root")).alias("root"), (F.col("low") < F.col("root")).alias("moved"))
            # the root of a root is nearer still
            roots = step.select("bin", F.col("part").alias("root"), F.col("root").alias("far"))
            step = materialize(step.join(roots, ["bin", "root"], "left").select("bin", "part", F.least("root", F.coalesce("far", "root")).alias("root"), "moved"), "roots")
            names = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"labels did not settle in {max_rounds} rounds")
    # numbers within a band of rows, and the numbers that the bands before it take
    roots = materialize(names.select("bin", "root").distinct().withColumn("band", F.floor(F.shiftright("root", 32) / tile)), "bands")
    sizes = roots.groupBy("bin", "band").agg(F.count(F.lit(1)).alias("size"))
    taken = sizes.withColumn("taken", F.sum("size").over(Window.partitionBy("bin").orderBy("band")) - F.col("size")).drop("size")
    place = F.row_number().over(Window.partitionBy("bin", "band").orderBy("root"))
    ranked = roots.withColumn("place", place).join(taken, ["bin", "band"]).select("bin", "root", (F.col("place") + F.col("taken")).cast("int").alias("comp_id"))
    named = names.join(ranked, ["bin", "root"]).select("bin", "part", "comp_id")
    return labelled.join(named, ["bin", "part"]).select("bin", "row", "col", "comp_id")


def zone_stats(labels: DataFrame, values: DataFrame, pixel_m2: float = PIXEL_M2, case: str = "diagnostic_case", covariates: Sequence[str] = ("z_ndvi", "z_r", "delta_swi_14d", "evidence_confidence")) -> DataFrame:
    """Per component the pixel count, area, most frequent case (smallest on a tie) and means of known covariates."""
    joined = labels.join(values, ["bin", "row", "col"])
    out = joined.groupBy("bin", "comp_id").agg(F.count(F.lit(1)).alias("pixel_count"), F.mode(F.col(case), True).alias("case"), *(F.avg(c).alias(f"mean_{c}") for c in covariates))
    return out.withColumn("area_m2", F.col("pixel_count") * F.lit(float(pixel_m2))).withColumn("case_type", case_name(F.col("case")))


def large_enough(zones: DataFrame, least_m2: float = MMU_M2) -> DataFrame:
    """P11."""
    return zones.where(F.col("area_m2") >= least_m2)


def zone_id(start, comp_id):
    """SC-YYYYMMDD-0001."""
    return F.format_string("SC-%s-%04d", F.coalesce(F.date_format(start, "yyyyMMdd"), F.lit("YYYYMMDD")), comp_id)


def boundary_edges(labels: DataFrame) -> DataFrame:
    """V6: directed unit edges (r0, c0, r1, c1) around each component, counter-clockwise for rows that go up;
    edges that two cells share in opposite directions cancel out."""
    r, c = F.col("row"), F.col("col")
    corners = [((r, c), (r, c + 1)), ((r, c + 1), (r + 1, c + 1)), ((r + 1, c + 1), (r + 1, c)), ((r + 1, c), (r, c))]
    sides = F.array(*(F.struct(a[0].alias("r0"), a[1].alias("c0"), b[0].alias("r1"), b[1].alias("c1")) for a, b in corners))
    edges = labels.select("bin", "comp_id", F.explode(sides).alias("e")).select("bin", "comp_id", "e.*")
    ends = [F.struct(F.col(f"r{k}").alias("r"), F.col(f"c{k}").alias("c")) for k in (0, 1)]
    low, high = F.least(*ends), F.greatest(*ends)
    own = edges.groupBy("bin", "comp_id", low.alias("a"), high.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("r0", "c0", "r1", "c1")).alias("e")).where("n = 1")
    return own.select("bin", "comp_id", "e.*")


def _stitched(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Rings of (row, col) corners; where two cells touch at a corner only, the ring turns left and stays with its cell."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for r0, c0, r1, c1 in sorted(edges):
        out[r0, c0].append((r1, c1))
    rings = []
    while out:
        start = min(out)
        ring, at, way = [start], start, None
        while True:
            choices = out[at]
            if len(choices) > 1 and way is not None:
                left = (at[0] + way[1], at[1] - way[0])
                nxt = left if left in choices else choices[0]
            else:
                nxt = choices[0]
            choices.remove(nxt)
            if not choices:
                del out[at]
            way = (nxt[0] - at[0], nxt[1] - at[1])
            at = nxt
            ring.append(at)
            if at == start:
                break
        corners = [p for k, p in enumerate(ring[:-1]) if (ring[k - 1 if k else -2][0] - p[0]) * (ring[k + 1][1] - p[1]) != (ring[k - 1 if k else -2][1] - p[1]) * (ring[k + 1][0] - p[0])]
        rings.append([*corners, corners[0]])
    return rings


def _ring_area(ring: Sequence[tuple[int, int]]) -> float:
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _holds(ring: Sequence[tuple[int, int]], r: float, c: float) -> bool:
    hit = False
    for (r0, c0), (r1, c1) in zip(ring, ring[1:], strict=False):
        if (r0 > r) != (r1 > r) and c < c0 + (c1 - c0) * (r - r0) / (r1 - r0):
            hit = not hit
    return hit


def zone_rings(edges: DataFrame) -> DataFrame:
    """V6: (bin, comp_id, polygons) with polygons as lists of rings of [row, col] corners; the first ring is the outer one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rings = _stitched(list(zip(*(table.column(c).to_pylist() for c in ("r0", "c0", "r1", "c1")), strict=True)))
        outer = [r for r in rings if _ring_area(r) > 0]
        polygons = [[r] for r in outer]
        for hole in (r for r in rings if _ring_area(r) < 0):
            (r0, c0), (r1, c1) = hole[0], hole[1]
            # a point just inside the zone beside the hole's first edge
            step_r, step_c = (r1 > r0) - (r1 < r0), (c1 > c0) - (c1 < c0)
            r, c = r0 + step_r * 0.5 + step_c * 0.25, c0 + step_c * 0.5 - step_r * 0.25
            home = min((p for p in polygons if _holds(p[0], r, c)), key=lambda p: _ring_area(p[0]), default=polygons[0])
            home.append(hole)
        shape = [[[[float(a), float(b)] for a, b in ring] for ring in p] for p in polygons]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([json.dumps(shape)], pa.string())], names=["bin", "comp_id", "corners"])

    return edges.groupBy("bin", "comp_id").applyInArrow(run, "bin bigint, comp_id int, corners string").withColumn("polygons", F.from_json("corners", "array<array<array<array<double>>>>")).drop("corners")


def to_lonlat(polygons, x0: float, y0: float, step: float):
    """V7: corners in rows and columns to [longitude, latitude]; (x0, y0) is the centre of cell (0, 0)."""
    def place(p):
        return F.array(cea_lon(F.lit(x0) + (p[1] - 0.5) * step), cea_lat(F.lit(y0) + (p[0] - 0.5) * step))

    return F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, place)))


def scouting_zones(screened: DataFrame, x0: float, y0: float, step: float = 30.0, opened: bool = True, least_m2: float = MMU_M2, start: str = "bin_start") -> tuple[DataFrame, DataFrame]:
    """V0: (features, report).

    screened: (bin, bin_start, row, col, diagnostic_case, z_ndvi, z_r, delta_swi_14d,
    evidence_confidence).  features: one row for each zone, with a GeoJSON string; report:
    A13, one row for each bin.
    """
    area = step * step
    raw = screened.where(F.col("diagnostic_case").isin(1, 2, 4, 5))
    mask = opening(raw) if opened else raw.select("bin", "row", "col")
    labels = materialize(label_components(mask), "components")
    zones = materialize(zone_stats(labels, screened, area), "zones")
    kept = large_enough(zones, least_m2)
    shapes = zone_rings(boundary_edges(labels.join(kept.select("bin", "comp_id"), ["bin", "comp_id"], "left_semi")))
    centre = labels.groupBy("bin", "comp_id").agg((F.lit(x0) + F.avg("col") * step).alias("cx"), (F.lit(y0) + F.avg("row") * step).alias("cy"))
    starts = screened.groupBy("bin").agg(F.min(start).alias(start))
    out = kept.join(shapes, ["bin", "comp_id"]).join(centre, ["bin", "comp_id"]).join(starts, "bin")
    hectares = F.col("area_m2") / 10_000
    ring_area = F.aggregate("polygons", F.lit(0.0), lambda s, rings: s + F.aggregate(rings, F.lit(0.0), lambda u, ring: u + F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda v, k: v + (F.get(F.get(ring, k - 1), F.lit(1)) * F.get(F.get(ring, k), F.lit(0)) - F.get(F.get(ring, k), F.lit(1)) * F.get(F.get(ring, k - 1), F.lit(0))) / 2)))
    out = out.withColumn("geom_area_m2", ring_area * area)
    properties = F.struct(
        zone_id(F.col(start), F.col("comp_id")).alias("zone_id"), "case_type", F.round(hectares, 4).alias("area_ha"),
        F.round(F.col("geom_area_m2") / 10_000, 4).alias("geom_area_ha"), (F.abs(F.col("geom_area_m2") - F.col("area_m2")) <= area).alias("area_ha_match"),
        "pixel_count", F.lit(round(area, 4)).alias("pixel_area_m2"), F.round("mean_z_ndvi", 4).alias("mean_z_ndvi"), F.round("mean_z_r", 4).alias("mean_z_r"),
        F.round("mean_delta_swi_14d", 4).alias("mean_delta_swi_14d"), F.round("mean_evidence_confidence", 4).alias("mean_confidence"),
        F.round(cea_lat(F.col("cy")), 6).alias("centroid_lat"), F.round(cea_lon(F.col("cx")), 6).alias("centroid_lon"),
    )
    shape = to_lonlat(F.col("polygons"), x0, y0, step)
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(shape, F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), shape.alias("coordinates")))
    geometry = F.when(F.size("polygons") == 1, one).otherwise(many)
    out = out.select("bin", start, "comp_id", properties.alias("properties"), geometry.alias("geometry"))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geometry"), F.lit(',"properties":'), F.to_json("properties", {"ignoreNullFields": "false"}), F.lit("}"))
    return out.withColumn("feature", feature), zone_report(screened, mask, zones, area, least_m2)


def zone_report(screened: DataFrame, mask: DataFrame, zones: DataFrame, pixel_m2: float = PIXEL_M2, least_m2: float = MMU_M2) -> DataFrame:
    """Per bin the pixels before and after opening, and the components, removed and surviving."""
    raw = screened.groupBy("bin").agg(F.count_if(F.col("diagnostic_case").isin(1, 2, 4, 5)).alias("raw_actionable_pixels"))
    after = mask.groupBy("bin").agg(F.count(F.lit(1)).alias("post_morphology_pixels"))
    fits = F.col("area_m2") >= least_m2
    parts = zones.groupBy("bin").agg(F.count(F.lit(1)).alias("n_connected_components"), F.count_if(~fits).alias("n_components_removed_mmu"), F.count_if(fits).alias("n_surviving_clusters"), F.sum(F.when(fits, F.col("area_m2"))).alias("final_total_area_m2"))
    out = raw.join(after, "bin", "left").join(parts, "bin", "left").na.fill(0)
    for name in ("raw_actionable", "post_morphology"):
        m2 = F.round(F.col(f"{name}_pixels") * pixel_m2, 2)
        out = out.withColumn(f"{name}_area_m2", m2).withColumn(f"{name}_area_ha", F.round(m2 / 10_000, 4))
    return out.withColumn("final_total_area_ha", F.round(F.col("final_total_area_m2") / 10_000, 4)).withColumn("pixel_area_m2", F.lit(float(pixel_m2)))
