"""A table of unit vectors (id, source_key, embedding) by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable, Refused
from .dense import faults

InvalidVectors = Refused


class VectorStore(KeyedTable):
    """Vectors of one dimension; a batch with one that is empty, of another dimension, not finite or not of length 1 is refused."""

    def __init__(self, spark: SparkSession, root: str, dims: int, kind: str = "bigint", tolerance: float = 1e-3, buckets: int = 16):
        super().__init__(spark, root, "id", f"id {kind}, source_key string, embedding array<double>", buckets, lambda: faults(F.col("embedding"), dims, tolerance))

    def remove_source(self, source_key: str) -> int:
        """Remove a source's vectors; how many those were, none the second time."""
        gone: DataFrame = self.read().where(F.col("source_key") == source_key).select("id")
        n = gone.count()
        if n:
            self.delete(gone)
        return n
