"""Session settings for local runs, and the shared scratch folder for written tables."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A side of a join is broadcast up to this size, as measured.
MEASURED_BYTES = 4 * 1024 * 1024


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clauseloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plan_by_sizes(spark: SparkSession) -> None:
    """Let only sizes measured at run time decide what is broadcast.

    Sizes known before a run are those of compressed files, and count neither unfolded arrays nor joined
    rows: a side planned at 10 MB was measured at 218 MB, and the driver holds every broadcast. A session
    whose run-time threshold has been set keeps its settings."""
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(MEASURED_BYTES))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a ``local`` session, one process, may fall back to a
    folder of this machine; anywhere else an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="clauseloom-")
        _OWN[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def new_path(spark: SparkSession, stem: str) -> str:
    """A path nothing has been written to yet, inside the shared folder."""
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    app, package = spark.sparkContext.applicationId, os.path.dirname(os.path.abspath(__file__))
    if app in _SHIPPED:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    path = os.path.join(tempfile.mkdtemp(prefix="clauseloom-ship-"), "clauseloom.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows to all cores if the table is too small to have a split for each of them.

    A small file often has one row group, which one task reads. Above one full split per core the
    scan is parallel by itself, and the rows stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(size) < cores * SPLIT_BYTES else df


#: Bytes of files whose rows one part gets when texts are dealt out.
PART_BYTES = 8 * 1024 * 1024


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out rows by ``keys``, in so many parts that what a part unfolds to stays small."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Rows that don't come from files have no size.
    return df.repartition(max(cores, size // PART_BYTES), *keys) if size < 1 << 50 else df.repartition(*keys)


#: Whether the shuffle files of a query are dropped when it ends; else they stay until the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as parquet; nothing reads the shuffle files of this write again, so they go with its end."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before) if before is not None else conf.unset(DROP_SHUFFLES)


#: What ``cut_lineage`` has written, in order.
_WRITTEN: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives the loss of executors."""
    path = new_path(df.sparkSession, "stage")
    write_table(df, path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.__dict__["_written"] = path
    _WRITTEN.append(path)
    return made


def _deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` has written and that nothing reads any more, such as those of a
    round before. Other frames are left alone."""
    for table in tables:
        path = table.__dict__.pop("_written", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _deleted(table.sparkSession, [path])


_STAGED: dict[tuple[str, str, str], tuple[tuple, str]] = {}


def file_versions(spark: SparkSession, source: str) -> tuple:
    """Number, bytes, latest change and a hash sum of all data files below ``source`` (path, size, time
    of change of each), without reading any. One row, however many files there are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(each)).first())


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A relation that several queries start from, written once per state of the source folder's files
    and read from there afterwards, with the reader's pushdown and column pruning. When a file of the
    folder is added, replaced or removed, the relation is built anew."""
    key, now = (spark.sparkContext.applicationId, source, name), file_versions(spark, source)
    if key not in _STAGED or _STAGED[key][0] != now:
        before = len(_WRITTEN)
        df = build()
        path = new_path(spark, name)
        write_table(df, path)
        _STAGED[key] = (now, path)
        # Tables that were written on the way are read by nothing else.
        left = _WRITTEN[before:]
        del _WRITTEN[before:]
        _deleted(spark, left)
    return spark.read.parquet(_STAGED[key][1])
