"""Shared tables between jobs, and columns that may be missing or clash."""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import released, small_batches  # noqa: F401 - for the operators here

_own: dict[str, str] = {}

#: ASCII blanks; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local master may go without it; its own temporary folder serves then.
    """
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


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    scratch() leaves it alone if `keep`.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    if _open and not keep:
        _open[-1].append(out)
    return out


_open: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What written() makes inside is removed at the end; the caller has stored by then what it needs of it."""
    _open.append([])
    try:
        yield
    finally:
        for table in _open.pop():
            discard(table)


def discard(df: DataFrame) -> None:
    """Remove a table that written() made, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """How many partitions hold about `each` rows; at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A row per source or language as part of the plan, so that Spark knows their size before it chooses a join.

    Rows of a Python list have no known size: a join with them shuffles the other side first.
    """
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(made).alias("row")).select("row.*")


def packed(df: DataFrame) -> Column:
    """All columns of `df` as one struct, so that no name of theirs can clash with an internal one."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
