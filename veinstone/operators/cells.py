"""Exact dense search that leaves out cells of vectors: each has a centre and a radius, which bound what its vectors can score.

Centres are drawn from the vectors; every vector goes to its nearest centre, into the folder of that cell. For a query q a vector of a cell
scores q . centre + |q| * radius at most. A search reads the cells with the highest bounds first; once the k-th best score is known, only
cells whose bound reaches it are read, all in one go. What is left out is proven to score less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dense

#: Centres at most, so that their table has a bounded size; cells that a query reads first.
MOST_CELLS, FIRST = 4096, 2
#: Wider than the rounding of scores and of sums.
SLACK = 2e-6


def build(vectors: DataFrame, root: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Write `vectors` into cells below `root`, about the root of their number unless `cells` says how many.

    Vectors that are null, hold a null or a number that is not finite, or have another length than the first by id, are left out.
    """
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = own.orderBy("id").limit(1).collect()
    dims = len(first[0].vector) if first else 0
    own = own.where(F.size("vector") == dims)
    count = own.count()
    wanted = min(MOST_CELLS, cells or max(1, round(count**0.5)))
    drawn = own.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    centres = np.array([r.vector for r in drawn], np.float64).reshape(len(drawn), dims)
    half = (centres * centres).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                cell = (x @ centres.T - half).argmax(axis=1)
                away = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "vector", "cell", "away"])

    kind = own.schema["id"].dataType.simpleString()
    made = own.mapInArrow(run, f"id {kind}, vector array<double>, cell int, away double")
    made.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{root}/vectors")
    stored = vectors.sparkSession.read.schema(f"id {kind}, vector array<double>, away double, cell int").parquet(f"{root}/vectors")
    heads = stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    named = vectors.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "k int, centre array<double>")
    heads.join(named, F.col("cell") == F.col("k")).select("cell", "centre", "radius", "n", F.lit(dims).alias("dims"), F.lit(kind).alias("kind")).coalesce(1).write.parquet(f"{root}/cells")


class Cells:
    """An index that build() wrote; opening it checks its dimension and that all rows are there."""

    def __init__(self, spark: SparkSession, root: str, dims: int | None = None):
        self.spark, self.root = spark, root
        heads = sorted(spark.read.parquet(f"{root}/cells").collect(), key=lambda r: r.cell)
        self.dims, self.kind = (heads[0].dims, heads[0].kind) if heads else (dims or 0, "bigint")
        if dims is not None and heads and dims != self.dims:
            raise ValueError(f"the index has {self.dims} dimensions, not {dims}")
        self.cells, self.rows = np.array([r.cell for r in heads], np.int64), sum(r.n for r in heads)
        self.centres, self.radius = np.array([r.centre for r in heads], np.float64).reshape(len(heads), self.dims), np.array([r.radius for r in heads], np.float64)
        there = self.read(self.cells).count()
        if there != self.rows:
            raise ValueError(f"{there} rows of {self.rows}")
        self.opened: dict[int, int] = {}

    def read(self, cells: np.ndarray) -> DataFrame:
        """The vectors of some cells; no other folder is read."""
        rows = self.spark.read.schema(f"id {self.kind}, vector array<double>, away double, cell int").parquet(f"{self.root}/vectors") if self.rows else self.spark.createDataFrame([], f"id {self.kind}, vector array<double>, away double, cell int")
        return rows.where(F.col("cell").isin([int(c) for c in cells]))

    def top_k(self, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
        """query_id, id, score, rank of the k best inner products of each query, rounded, ties by id; exact."""
        if any(len(v) != self.dims for _, v in queries if self.rows):
            raise ValueError(f"queries must have {self.dims} dimensions")
        if not self.rows or not queries:
            return self.spark.createDataFrame([], f"query_id long, id {self.kind}, score double, rank int")
        q = np.array([v for _, v in queries], np.float64)
        bound = q @ self.centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.radius + SLACK
        order = np.argsort(-bound, axis=1, kind="stable")
        first = np.unique(order[:, :FIRST])
        found = dense.ranked(dense.score_batches(self.read(self.cells[first]), queries, k, "id", "vector"), k)
        # The k-th best of the cells that were read first, or nothing to go by.
        least = {r.query_id: r.score for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}
        need = {j: np.flatnonzero(bound[j] >= least.get(queries[j][0], -np.inf)) for j in range(len(queries))}
        every = np.union1d(first, np.concatenate(list(need.values())))
        self.opened = {queries[j][0]: len(np.union1d(first, cells)) for j, cells in need.items()}
        return dense.ranked(dense.score_batches(self.read(self.cells[every]), queries, k, "id", "vector"), k)
