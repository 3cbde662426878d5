"""Spark sessions with the settings that the plans here are written for."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "veinstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; `master` None leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """`rows` in as many partitions as there are cores, if there are fewer.

    A file of one row group is one partition, however costly its rows are to process. Tables of many files,
    at any larger scale, are left as they are and not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """From now on the session sends at most `rows` rows, of about `size` bytes, to Python at once.

    Whole texts of ten thousand documents in one batch, Spark's default, take hundreds of megabytes on
    both sides of the pipe. The settings are only ever lowered; they stay, as plans run after this returns.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, a function over batches, that gives freed memory back at its end: Python workers stay for later tasks, and keep it else."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only a local master may go without it; its own temporary folder serves then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="veinstone-")
        atexit.register(shutil.rmtree, _own[key], True)
    return f"file://{_own[key]}"


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files below `path`: another stamp, other contents."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
