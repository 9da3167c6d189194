"""Sources and their checks.

Sources are Parquet paths, DataFrames, or lists of either.  Aliases of columns are renamed
and NaN becomes null, but not in coordinates: filters on them and on times are on the raw
columns, so that they reach the scan, and no box holds a NaN.  Only ``validate_*`` and the
inference of units run a job: one aggregate each.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.errors import RangeError
from pixelloom.functions.indices import known

#: Names under which sources carry the same column.
ALIASES = {
    "time": "t", "date": "t", "datetime": "t", "valid_time": "t",
    "latitude": "lat", "longitude": "lon", "Latitude": "lat", "Longitude": "lon",
    "precip": "rainfall", "precipitation": "rainfall", "tp": "rainfall",
    "sm_surface_wetness": "s0", "sm_rootzone_wetness": "s1",
}


@dataclass(frozen=True)
class Modality:
    """What a modality holds on its own grid."""

    name: str
    grid: str
    cadence: str
    crs: str
    variables: tuple[str, ...]
    nodata: str = "null"


#: The modalities.
MODALITIES = {
    m.name: m
    for m in (
        Modality("optical", "10-20 m", "5 days", "EPSG:32736", ("b02", "b03", "b04", "b08", "b11", "scl")),
        Modality("climate", "0.05 degrees", "daily or monthly", "EPSG:4326", ("rainfall",)),
        Modality("hydrology", "0.1 degrees or 9 km", "daily", "EPSG:4326", ("s0", "s1")),
        Modality("crop_mask", "20 m", "static", "EPSG:32736", ("crop_mask",)),
    )
}


Source = str | DataFrame
COORDINATES = ("lat", "lon")


def read(spark: SparkSession, source: Source | Sequence[Source]) -> DataFrame:
    """A source's rows with its aliases renamed and NaN as null; of several, all rows."""
    if not isinstance(source, str | DataFrame):
        return concat([read(spark, s) for s in source])
    df = spark.read.parquet(source) if isinstance(source, str) else source
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType) and f.name not in COORDINATES]
    return df.withColumns({c: known(F.col(c)) for c in floats}) if floats else df


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts one after the other, such as years; a variable that a part lacks is null there."""
    if not parts:
        raise ValueError("nothing to read")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def merge(variables: Mapping[str, DataFrame], keys: Sequence[str] = ("t", "lat", "lon")) -> DataFrame:
    """One row for each key that any variable has; each part gives its own variable."""
    if not variables:
        raise ValueError("no variables")
    out = None
    for name, df in variables.items():
        part = df.select(*keys, name)
        out = part if out is None else out.join(part, list(keys), "full")
    return out


def between_times(df: DataFrame, start: str | datetime, end: str | datetime, t: str = "t") -> DataFrame:
    """Both ends included; an end given as a date means its midnight."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return df.where((F.col(t).cast("timestamp") >= first) & (F.col(t).cast("timestamp") <= last))


def in_bbox(df: DataFrame, bbox: Sequence[float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cell centres within (min_lon, min_lat, max_lon, max_lat), ends included."""
    return df.where(F.col(lon).between(bbox[0], bbox[2]) & F.col(lat).between(bbox[1], bbox[3]))


def axis_step(df: DataFrame, axis: str, default: float) -> float:
    """The distance of the axis's first two coordinates; ``default`` for a single one."""
    two = [r[0] for r in df.where(F.col(axis).isNotNull() & ~F.isnan(F.col(axis).cast("double"))).select(axis).distinct().orderBy(axis).limit(2).collect()]
    return abs(two[1] - two[0]) if len(two) > 1 else default


def in_padded_bbox(df: DataFrame, bbox: Sequence[float], step: float | None = None, default: float = 0.1, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The box grows by half a cell on every side."""
    pad_lat = (step if step is not None else axis_step(df, lat, default)) / 2
    pad_lon = (step if step is not None else axis_step(df, lon, default)) / 2
    return in_bbox(df, (bbox[0] - pad_lon, bbox[1] - pad_lat, bbox[2] + pad_lon, bbox[3] + pad_lat), lat, lon)


def within(value: Column, low: float | None = None, high: float | None = None, fill: float | None = None) -> Column:
    """Null outside of [low, high] or where equal to ``fill``."""
    good = F.lit(True)
    if low is not None:
        good = good & (value >= low)
    if high is not None:
        good = good & (value <= high)
    if fill is not None:
        good = good & (value != fill)
    return F.when(good, value)


def fraction_of(df: DataFrame, name: str, units: str = "auto") -> Column:
    """A share of 1, clipped to it.  units: ``percent``, ``fraction`` or ``auto``, which
    takes the whole variable for percent if its largest value is over 1.5."""
    v = within(F.col(name), 0.0, 100.0)
    if units == "auto":
        top = df.select(F.max(v)).scalar()
        v = F.when(top > 1.5, v / 100).otherwise(v)
    elif units == "percent":
        v = v / 100
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)))


def _check_span(start, end) -> None:
    if str(start) > str(end):
        raise ValueError(f"start {start} is after end {end}")


def load_optical(spark, source, bands: Iterable[str], start, end, bbox: Sequence[float] | None = None) -> DataFrame:
    """The wanted bands that exist; integers stay integers.  bbox: where the source has lat and lon."""
    _check_span(start, end)
    df = read(spark, source)
    lower = {c.lower(): c for c in df.columns}
    chosen = [lower[b.lower()] for b in bands if b.lower() in lower]
    if not chosen:
        raise ValueError("none of the wanted bands is there")
    keys = [c for c in ("t", "row", "col", "y", "x", "lat", "lon") if c in df.columns]
    df = df.select(*keys, *chosen)
    return between_times(in_bbox(df, bbox) if bbox is not None and set(COORDINATES) <= set(keys) else df, start, end)


def load_rainfall(spark, source, bbox, start, end, fill: float | None = -9999.0) -> DataFrame:
    """Exact box, times inclusive, fill values and negatives to null."""
    _check_span(start, end)
    df = between_times(in_bbox(read(spark, source), bbox), start, end)
    return df.withColumn("rainfall", within(F.col("rainfall"), 0.0, fill=fill))


def load_soil(spark, source: Source | Sequence[Source] | Mapping[str, Source | Sequence[Source]], bbox, start, end, variables: Sequence[str] = ("s0", "s1"), units: str = "auto", default_step: float = 0.1) -> DataFrame:
    """Padded box, times inclusive, values as shares of 1.

    source: one source, several (such as years) to be put one after the other, or either of
    these for each variable, to be merged on time and place (J8).
    """
    _check_span(start, end)
    if isinstance(source, Mapping):
        parts = {v: between_times(in_padded_bbox(read(spark, source[v]), bbox, default=default_step), start, end) for v in variables if v in source}
        df = merge(parts)
    else:
        df = between_times(in_padded_bbox(read(spark, source), bbox, default=default_step), start, end)
    return df.withColumns({v: fraction_of(df, v, units) for v in variables if v in df.columns})


def load_soil_subdaily(spark, source, bbox, start, end, variables: Sequence[str] = ("s0", "s1")) -> DataFrame:
    """As I9 at 0.08 degrees; sub-daily steps become daily means before masking."""
    _check_span(start, end)
    df = between_times(in_padded_bbox(read(spark, source), bbox, default=0.08), start, end)
    names = [v for v in variables if v in df.columns]
    days = df.groupBy(F.to_date("t").alias("t"), "lat", "lon").agg(*(F.avg(v).alias(v) for v in names))
    return days.withColumns({v: within(F.col(v), 0.0, 1.0) for v in names})


def load_crop_mask(spark, source, bbox=None, name: str = "crop_mask") -> DataFrame:
    """1 and 0; class 40 counts if any value is over 1.5, else every positive value."""
    df = read(spark, source)
    if bbox is not None and {"lat", "lon"} <= set(df.columns):
        df = in_bbox(df, bbox)
    top = df.select(F.max(F.col(name))).scalar()
    binary = F.when(top > 1.5, F.col(name) == 40).otherwise(F.col(name) > 0)
    return df.withColumn(name, binary.cast("double"))


def decode_days(df: DataFrame, days: str = "days", t: str = "t") -> DataFrame:
    """Days since 1970 to timestamps; sentinels (null, non-finite, <= 0, >= 1e6) go."""
    d = F.col(days)
    good = d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < 1e6)
    return df.where(good).withColumn(t, F.timestamp_micros((F.round(d * 86400) * 1000000).cast("bigint")))


def require_range(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> None:
    """Raise if a column leaves its limits; one aggregate for all columns."""
    names = [c for c in limits if c in df.columns]
    if not names:
        return
    row = df.agg(*(f(c).alias(f"{g}_{c}") for c in names for f, g in ((F.min, "low"), (F.max, "high")))).first()
    for c in names:
        low, high = row[f"low_{c}"], row[f"high_{c}"]
        if low is not None and (low < limits[c][0] or high > limits[c][1]):
            raise RangeError(f"{c} spans [{low}, {high}], outside of {limits[c]}")


def validate_optical(df: DataFrame) -> None:
    """SCL 0..11; integer bands 0..20000; float bands -0.05..1.5."""
    if "t" not in df.columns:
        raise ValueError("a time column t is needed")
    bands = [f for f in df.schema.fields if f.name.lower().startswith("b") and f.name[1:].isdigit()]
    limits = {f.name: ((0, 20000) if isinstance(f.dataType, T.IntegralType) else (-0.05, 1.5)) for f in bands}
    require_range(df, limits | {"scl": (0, 11)})


def validate_rainfall(df: DataFrame, units: str = "mm", ordinal: str | None = None) -> None:
    """I4."""
    if units not in ("mm", "mm/day", "mm/month"):
        raise ValueError(f"unknown unit {units}")
    require_range(df, {"rainfall": (-0.01, 1500.0)})
    if ordinal:
        require_monotonic(df, ordinal)


def validate_soil(df: DataFrame, variables: Sequence[str] = ("s0", "s1"), percent: bool = False, ordinal: str | None = None) -> None:
    """I8, I11."""
    high = 100.01 if percent else 1.01
    require_range(df, {v: (-0.01, high) for v in variables})
    if ordinal:
        require_monotonic(df, ordinal)


def validate_crop_mask(df: DataFrame, name: str = "crop_mask") -> None:
    """0 and 1 only."""
    if df.where(F.col(name).isNotNull() & ~F.col(name).isin(0, 1)).limit(1).count():
        raise RangeError(f"{name} holds values other than 0 and 1")


def time_reversals(df: DataFrame, ordinal: str, t: str = "t") -> DataFrame:
    """The distinct times that come before their predecessor in order of arrival."""
    steps = df.groupBy(t).agg(F.min(ordinal).alias("ordinal"))  # one row for each time step
    before = F.lag(t).over(Window.orderBy("ordinal"))
    return steps.withColumn("before", before).where(F.col(t) < F.col("before")).select(t, "before")


def require_monotonic(df: DataFrame, ordinal: str, t: str = "t") -> None:
    if not time_reversals(df, ordinal, t).isEmpty():
        raise ValueError("times are not in order")


#: File names of the yearly soil-moisture archive.
_ARCHIVE = {"s0": "GRAFS_TopSoilRelativeWetness", "s1": "GRAFS_RootzoneSoilWaterIndex"}
_ARCHIVE_NAMES = {"s0": "s0", "topsoil": "s0", "topsoilrelativewetness": "s0", "s1": "s1", "rootzone": "s1", "rootzonesoilwaterindex": "s1"}


def archive_url(variable: str, year: int, base: str) -> str:
    """The address of a variable's yearly file."""
    key = _ARCHIVE_NAMES.get(variable.lower())
    if key is None:
        raise ValueError(f"unknown variable {variable}")
    return f"{base.rstrip('/')}/{_ARCHIVE[key]}_{int(year)}.nc"


def with_retry(open_it: Callable[[], object], tries: int = 3, base: float = 1.5, sleep: Callable[[float], None] = time.sleep):
    """Try again after base * 2**(k - 1) seconds; ConnectionError after the last."""
    last: Exception | None = None
    for k in range(1, tries + 1):
        try:
            return open_it()
        except OSError as error:
            last = error
            if k < tries:
                sleep(base * 2 ** (k - 1))
    raise ConnectionError(f"not reached after {tries} tries: {last}")


def granules(fetch: Callable[[dict], Mapping], bbox: Sequence[float], start: str, end: str, short_name: str, page_size: int = 2000) -> list[Mapping]:
    """Entries of a metadata search; ``fetch`` does the request and checks certificates."""
    query = {"short_name": short_name, "bounding_box": ",".join(str(v) for v in bbox), "temporal": f"{start},{end}", "page_size": page_size}
    out: list[Mapping] = []
    while True:  # pages until one is not full
        page = list(fetch(query | {"page_num": len(out) // page_size + 1}).get("feed", {}).get("entry", []))
        out += page
        if len(page) < page_size:
            return out


#: Fields that a data set's provenance must have.
PROVENANCE = ("source_name", "product_name", "product_version", "access_timestamp_utc", "spatial_resolution", "temporal_resolution", "native_crs", "known_limitations")


def provenance(source_name: str, product_name: str, product_version: str, spatial_resolution: str, temporal_resolution: str, native_crs: str, known_limitations: Sequence[str], transformations: Sequence[str] = (), url: str | None = None, collection: str | None = None, extra: Mapping[str, object] | None = None) -> dict[str, str]:
    """A flat map of strings; lists join with ``; ``, no transformations are ``none``."""
    out = {
        "source_name": source_name, "product_name": product_name, "product_version": product_version,
        "access_timestamp_utc": datetime.now(UTC).isoformat(), "spatial_resolution": spatial_resolution,
        "temporal_resolution": temporal_resolution, "native_crs": native_crs,
        "known_limitations": "; ".join(known_limitations), "transformations_applied": "; ".join(transformations) or "none",
    }
    out |= {"source_url": url} if url else {}
    out |= {"collection_id": collection} if collection else {}
    out |= {k: str(v) for k, v in (extra or {}).items()}
    return {f"provenance_{k}": v for k, v in out.items()}


def attach_provenance(df: DataFrame, attrs: Mapping[str, str]) -> DataFrame:
    """The map as metadata of every column, where it costs no bytes in rows."""
    return df.select(*(F.col(c).alias(c, metadata=dict(df.schema[c].metadata) | dict(attrs)) for c in df.columns))


def missing_provenance(attrs: Column) -> Column:
    """The mandatory fields that a map lacks."""
    return F.filter(F.array(*(F.lit(f"provenance_{k}") for k in PROVENANCE)), lambda k: F.coalesce(F.element_at(attrs, k), F.lit("")) == "")


def validate_provenance(attrs: Mapping[str, str]) -> None:
    gone = [k for k in PROVENANCE if not attrs.get(f"provenance_{k}")]
    if gone:
        raise ValueError(f"provenance lacks {', '.join(gone)}")


@dataclass
class Cube:
    """Up to four modalities, each on its own grid, and the box they cover."""

    bbox: tuple[float, float, float, float] | None = None
    members: dict[str, DataFrame] = field(default_factory=dict)

    def validate(self, required: Sequence[str] = ()) -> None:
        for name in required:
            if self.members.get(name) is None:
                raise ValueError(f"modality {name} is missing")
        for name, df in self.members.items():
            if name not in MODALITIES:
                raise ValueError(f"unknown modality {name}")
            validate_provenance(df.schema.fields[0].metadata)

    def summary(self) -> dict[str, dict]:
        return {name: {"variables": df.columns, "rows": df.count()} for name, df in self.members.items()}
