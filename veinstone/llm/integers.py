"""Vectors of an Arrow batch as rows of whole numbers, and parts of many tasks merged in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024


def scaled(column: pa.ListArray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, floor(SCALE * x) as rows of longs) of the vectors of each length.

    Left out are null and empty vectors and those with a null, non-finite or, scaled, not below `limit`.
    """
    begins = column.offsets.to_numpy()
    lengths, begins = np.diff(begins), begins[:-1]
    lengths[np.asarray(column.is_null())] = 0
    values = column.values
    flat, null = values.to_numpy(zero_copy_only=False), np.asarray(values.is_null())
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        at = begins[rows][:, None] + np.arange(d)
        with np.errstate(over="ignore", invalid="ignore"):
            made = np.floor(SCALE * flat[at].astype(np.float64))
            good = (np.abs(made) < limit).all(axis=1) & ~null[at].any(axis=1)
        if good.any():
            yield rows[good], made[good].astype(np.int64)


def merged(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], bytes | None], merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """The parts that `part` makes of the partitions of `df`, merged in three steps to one; None without any.

    Each step deals the parts to fewer tasks, about the root of their number at the end, and a task holds
    two of them at a time.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = part(batches)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([made], pa.binary())], names=["at", "part"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole = 0, None
        for batch in batches:
            for own, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, whole = own, x.as_py() if whole is None else merge(whole, x.as_py())
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([whole], pa.binary())], names=["at", "part"])

    schema = "at long, part binary"
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.mapInArrow(first, schema)
    for tasks in (wide, int(np.ceil(np.sqrt(wide)))):
        parts = parts.withColumn("at", F.pmod("at", F.lit(tasks))).repartition(tasks, "at").mapInArrow(more, schema)
    rows = parts.repartition(1).mapInArrow(more, schema).collect()
    return bytes(rows[0].part) if rows else None
