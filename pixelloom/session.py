"""Session settings and lineage cutting shared by every subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIRS: dict[str, str] = {}
FILE_ROWS = 5_000  # rows of a small table for each of its files


def get_session(app: str = "pixelloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the
    cluster names one, else a temporary folder, which only local sessions get."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="pixelloom-")
    return "file://" + _OWN_DIRS[app]


def files_for(rows: int, each: int = FILE_ROWS) -> int:
    """The files for a table of at most so many rows, ``each`` in a file."""
    return max(1, -(-rows // each))


def materialize(df: DataFrame, name: str = "stage", files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with files every executor can reach, so a lost executor costs a
    re-read and never a recomputation.  The write's shuffle files go as soon as it is done;
    the files themselves go by ``free`` or when the driver's Python ends.

    files: no more than so many are written, by as many tasks, for tables whose size is
    known to be small.  Where Hadoop has no native library, a local file and its checksum
    each start a ``chmod``, a child that shares the executor's memory until it is running
    and so counts as much again; adaptive execution may be told not to merge partitions.
    """
    if files is not None:
        df = df.coalesce(files)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pixelloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody asks for the marker
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pixelloom_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_pixelloom_path", None)
        if path:
            _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway may be gone already; the folder is scratch
        return


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of an Arrow batch that Python workers get, for rows that may be wide."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
