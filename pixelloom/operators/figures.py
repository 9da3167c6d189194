"""Figures of a season as SVG text.

Spark prepares small tables: a row for each bin, the zones of one bin, or a heat map of at
most ``SIDE`` x ``SIDE`` blocks of pixels; drawing is text.  Colours belong to cases, not to
their order; marks carry tooltips, and cases are named beside their marks.  Every figure's
table is the argument it is drawn from.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 120  # blocks along either side of a heat map
WIDTH = 960

#: The cases that are drawn, their names and colours on light and dark ground.
CASES = {"case_b": ("Case B", "#2a78d6", "#3987e5"), "case_d": ("Case D", "#eb6834", "#d95926"), "multi": ("Multi-signal", "#1baf7a", "#199e70"), "case_a": ("Case A", "#8a8984", "#8f8e88")}
#: Thresholds of the rules, by panel of the profile.
PANELS = (
    ("mean_z_r", "Rainfall z", (0.5, -0.8)), ("mean_z_ndvi", "NDVI z", (-1.0, -1.2)),
    ("mean_swi", "Soil moisture", (0.3,)), ("mean_delta_swi_14d", "Soil change, 14 days", (0.0,)),
)
_RAMP = ("#cde2fb", "#b7d3f6", "#9ec5f4", "#86b6ef", "#6da7ec", "#5598e7", "#3987e5", "#2a78d6", "#256abf", "#1c5cab", "#184f95", "#104281", "#0d366b")


def _style() -> str:
    def roles(k: int) -> str:
        ground = (("#fcfcfb", "#0b0b0b", "#52514e", "#e3e2dc"), ("#1a1a19", "#ffffff", "#c3c2b7", "#3a3a37"))[k]
        return "".join(f"--{n}:{v};" for n, v in zip(("ground", "ink", "soft", "grid"), ground, strict=True)) + "".join(f"--{n}:{c[k + 1]};" for n, c in CASES.items())

    return (
        f"<style>svg{{{roles(0)}font-family:system-ui,sans-serif;background:var(--ground)}}@media(prefers-color-scheme:dark){{svg{{{roles(1)}}}}}"
        "text{fill:var(--soft);font-size:12px}.t{fill:var(--ink);font-size:16px;font-weight:600}.n{fill:var(--ink)}.g{stroke:var(--grid);stroke-width:1}.r{stroke:var(--soft);stroke-width:1;stroke-dasharray:4 4}"
        ".l{fill:none;stroke:var(--case_b);stroke-width:2}.m{fill:var(--case_b);stroke:var(--ground);stroke-width:2}.z{stroke:var(--ground);stroke-width:2}</style>"
    )


def _figure(title: str, height: float, body: Sequence[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {height:.0f}" role="img" aria-label="{escape(title)}">'
    return "\n".join([head, _style(), f'<rect width="{WIDTH}" height="{height:.0f}" fill="var(--ground)"/>', f'<text class="t" x="24" y="32">{escape(title)}</text>', *body, "</svg>"])


def _ticks(low: float, high: float, n: int = 4) -> list[float]:
    """Round numbers that span [low, high]."""
    span = (high - low) or 1.0
    step = 10 ** math.floor(math.log10(span / n))
    step *= next((k for k in (1, 2, 5, 10) if span / (step * k) <= n), 10)
    first = math.floor(low / step)
    return [k * step for k in range(first, math.ceil(high / step) + 1)]


def profile(rows: Sequence[Mapping], title: str = "Season profile") -> str:
    """R2: means of a season, a panel for each variable.  rows: bin_start and the panels'
    columns, in order; a missing value interrupts the line and is marked as undefined."""
    left, right, top, tall, gap = 70, WIDTH - 24, 64, 110, 44
    x = lambda k: left + (right - left) * (k + 0.5) / max(1, len(rows))
    out = []
    for p, (column, name, limits) in enumerate(PANELS):
        y0 = top + p * (tall + gap)
        known = [float(r[column]) for r in rows if r.get(column) is not None]
        ticks = _ticks(min([*known, *limits, 0.0]), max([*known, *limits, 0.0]))
        y = lambda v, y0=y0, ticks=ticks: y0 + tall - tall * (v - ticks[0]) / ((ticks[-1] - ticks[0]) or 1)
        out.append(f'<text class="n" x="{left}" y="{y0 - 10}">{escape(name)}</text>')
        for v in ticks:
            out.append(f'<line class="g" x1="{left}" x2="{right}" y1="{y(v):.1f}" y2="{y(v):.1f}"/><text x="{left - 8}" y="{y(v) + 4:.1f}" text-anchor="end">{v:g}</text>')
        for v in limits:
            out.append(f'<line class="r" x1="{left}" x2="{right}" y1="{y(v):.1f}" y2="{y(v):.1f}"><title>threshold {v:g}</title></line>')
        run: list[str] = []
        runs = [run]
        for k, r in enumerate(rows):
            if r.get(column) is None:
                run = []
                runs.append(run)
                out.append(f'<circle cx="{x(k):.1f}" cy="{y(0):.1f}" r="5" fill="none" stroke="var(--soft)"><title>{escape(str(r["bin_start"]))}: undefined</title></circle>')
            else:
                run.append(f"{x(k):.1f},{y(float(r[column])):.1f}")
        out += [f'<polyline class="l" points="{" ".join(p)}"/>' for p in runs if len(p) > 1]
        out += [f'<circle class="m" cx="{x(k):.1f}" cy="{y(float(r[column])):.1f}" r="5"><title>{escape(str(r["bin_start"]))}: {float(r[column]):.3f}</title></circle>' for k, r in enumerate(rows) if r.get(column) is not None]
    bottom = top + len(PANELS) * (tall + gap) - gap + 22
    every = max(1, math.ceil(len(rows) / 10))
    out += [f'<text x="{x(k):.1f}" y="{bottom}" text-anchor="middle">{escape(str(r["bin_start"]))}</text>' for k, r in enumerate(rows) if k % every == 0]
    return _figure(title, bottom + 20, out)


def timeline(rows: Sequence[Mapping], title: str = "Area by case, hectares") -> str:
    """Stacked areas of each bin.  rows: those of ``reporting.area_timeline``, in order."""
    left, right, top, tall = 70, WIDTH - 24, 84, 300
    total = [sum(float(r[f"{c}_area_ha"]) for c in CASES) for r in rows]
    ticks = _ticks(0.0, max([*total, 1.0]))
    y = lambda v: top + tall - tall * v / ticks[-1]
    slot = (right - left) / max(1, len(rows))
    bar = min(slot * 0.6, 40)
    out = [f'<rect x="{left + 120 * k}" y="48" width="12" height="12" rx="2" fill="var(--{c})"/><text x="{left + 120 * k + 18}" y="58">{name}</text>' for k, (c, (name, *_)) in enumerate(CASES.items())]
    out += [f'<line class="g" x1="{left}" x2="{right}" y1="{y(v):.1f}" y2="{y(v):.1f}"/><text x="{left - 8}" y="{y(v) + 4:.1f}" text-anchor="end">{v:g}</text>' for v in ticks]
    every = max(1, math.ceil(len(rows) / 10))
    for k, r in enumerate(rows):
        x, base = left + slot * (k + 0.5) - bar / 2, 0.0
        for c, (name, *_) in CASES.items():
            v = float(r[f"{c}_area_ha"])
            if v > 0:
                out.append(f'<rect x="{x:.1f}" y="{y(base + v):.1f}" width="{bar:.1f}" height="{max(1.0, y(base) - y(base + v) - 2):.1f}" rx="2" fill="var(--{c})"><title>{escape(str(r["bin_start"]))}, {name}: {v:.2f} ha</title></rect>')
                base += v
        if k % every == 0:
            out.append(f'<text x="{x + bar / 2:.1f}" y="{top + tall + 20}" text-anchor="middle">{escape(str(r["bin_start"]))}</text>')
    return _figure(title, top + tall + 44, out)


def zone_map(features: Sequence[str], bbox: Sequence[float], title: str = "Zones", least_ha: float = 5.0) -> str:
    """Zones of one bin as GeoJSON features within (west, south, east, north); those of
    ``least_ha`` and more are named at their centroid."""
    west, south, east, north = bbox
    top, wide = 56, WIDTH - 48
    tall = min(900.0, wide * (north - south) / ((east - west) or 1))
    x = lambda v: 24 + wide * (v - west) / ((east - west) or 1)
    y = lambda v: top + tall - tall * (v - south) / ((north - south) or 1)
    out, marks = [f'<rect x="24" y="{top}" width="{wide}" height="{tall:.1f}" fill="none" class="g"/>'], []
    area = 0.0
    for text in features:
        one = json.loads(text)
        said, shape = one["properties"], one["geometry"]["coordinates"]
        case = said["case_type"].lower()
        key = "multi" if case.startswith("multi") else case
        rings = [ring for polygon in (shape if one["geometry"]["type"] == "MultiPolygon" else [shape]) for ring in polygon]
        path = "".join("M" + "L".join(f"{x(a):.1f} {y(b):.1f}" for a, b, *_ in ring) + "Z" for ring in rings)
        area += said["area_ha"]
        out.append(f'<path class="z" fill-rule="evenodd" fill="var(--{key})" d="{path}"><title>{escape(said["zone_id"])}, {CASES[key][0]}: {said["area_ha"]:.2f} ha</title></path>')
        if said["area_ha"] >= least_ha:
            marks.append(f'<circle cx="{x(said["centroid_lon"]):.1f}" cy="{y(said["centroid_lat"]):.1f}" r="4" fill="var(--ink)"/><text class="n" x="{x(said["centroid_lon"]) + 8:.1f}" y="{y(said["centroid_lat"]) + 4:.1f}">{CASES[key][0]}, {said["area_ha"]:.1f} ha</text>')
    legend = [f'<rect x="{24 + 120 * k}" y="{top + tall + 14:.1f}" width="12" height="12" rx="2" fill="var(--{c})"/><text x="{42 + 120 * k}" y="{top + tall + 24:.1f}">{name}</text>' for k, (c, (name, *_)) in enumerate(CASES.items())]
    legend.append(f'<text x="{WIDTH - 24}" y="{top + tall + 24:.1f}" text-anchor="end">{len(features)} zones, {area:.2f} ha</text>')
    return _figure(title, top + tall + 44, out + marks + legend)


def heat_blocks(persisted: DataFrame, side: int = SIDE, value: str = "actionable_recurrence_count") -> DataFrame:
    """(row, col, value): means over square blocks, so that a map of any size has at most side x side of them."""
    span = persisted.agg(F.greatest(F.max("row") - F.min("row"), F.max("col") - F.min("col")).alias("n"), F.min("row").alias("r0"), F.min("col").alias("c0"))
    size, r0, c0 = (span.select(c).scalar() for c in (F.floor(F.col("n") / side) + 1, F.col("r0"), F.col("c0")))
    blocks = persisted.groupBy(F.floor((F.col("row") - r0) / size).cast("int").alias("row"), F.floor((F.col("col") - c0) / size).cast("int").alias("col"))
    return blocks.agg(F.avg(value).alias("value"))


def heat_map(rows: Sequence[Mapping], title: str = "Bins with a signal, by place") -> str:
    """Blocks of pixels by how often they were actionable.  rows: those of ``heat_blocks``; row 0 is the southernmost."""
    top, wide = 56, WIDTH - 160
    ny, nx = (max([r[c] for r in rows], default=0) + 1 for c in ("row", "col"))
    cell = min(wide / nx, 900 / ny)
    most = max([float(r["value"]) for r in rows], default=0.0)
    shade = lambda v: _RAMP[min(len(_RAMP) - 1, int(v / most * len(_RAMP)))] if most and v else "none"
    out = [f'<rect x="{24 + r["col"] * cell:.1f}" y="{top + (ny - 1 - r["row"]) * cell:.1f}" width="{cell:.2f}" height="{cell:.2f}" fill="{shade(float(r["value"]))}"><title>row {r["row"]}, column {r["col"]}: {float(r["value"]):.2f}</title></rect>' for r in rows]
    x = 24 + nx * cell + 24
    out += [f'<rect x="{x:.1f}" y="{top + 16 * (len(_RAMP) - 1 - k)}" width="16" height="16" fill="{c}"/>' for k, c in enumerate(_RAMP)]
    out += [f'<text x="{x + 24:.1f}" y="{top + 12}">{most:.1f} bins</text>', f'<text x="{x + 24:.1f}" y="{top + 16 * len(_RAMP)}">over 0</text>']
    return _figure(title, max(top + ny * cell, top + 16 * len(_RAMP)) + 24, out)
