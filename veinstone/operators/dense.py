"""Dense retrieval: unit vectors, exact top-k, and greedy selection for diversity.

Similarities are rounded to `DIGITS` places before ranking, and ties go to the smaller id, so that
the order doesn't depend on how sums were grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import released, small_batches

DIGITS = 6


def rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS places, halves away from zero, as SQL rounds."""
    return np.trunc(x * 10**DIGITS + np.copysign(0.5, x)) / 10**DIGITS


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / length))


def faults(v: Column, dims: int, tolerance: float = 1e-3) -> Column:
    """Why a vector can't be indexed, or null."""
    return (
        F.when(v.isNull() | (F.size(v) == 0), "empty")
        .when(F.size(v) != dims, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(F.abs(norm(v) - 1) > tolerance, "not unit")
    )


def hash_embedding(text: Column, dims: int = 8) -> Column:
    """A deterministic stand-in for a model, over whole texts: characters add (code mod 97) / 97 to the bucket of their place."""

    def made(texts: pd.Series) -> pd.Series:
        # One matrix for a batch; its rows are the vectors.
        out = np.zeros((len(texts), dims))
        for k, t in enumerate(texts):
            codes = np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) % 97 / 97
            out[k] = np.bincount(np.arange(len(codes)) % dims, codes, dims)
        return pd.Series(list(out))

    return F.pandas_udf(made, "array<double>")(text)


def score_batches(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, id_col: str, vector_col: str, scope_col: str | None = None, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """query_id, id, score (and scope): of each batch of rows the k best for each query, by matrix products.

    What leaves a batch is bounded by k for each query, so the ranked window behind it is small. Vectors that
    are null, of another dimension than the queries, or hold a null take no part. With `embed` the column holds texts, which become
    vectors in the batch.
    """
    names = [id_col, vector_col] + ([scope_col] if scope_col else [])
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = batch.column(0)
            if embed:
                made = embed([t or "" for t in batch.column(1).to_pylist()])
            else:
                made = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            scores = rounded(made @ matrix.T)
            for j, query in enumerate(ids):
                # All ties at the border leave the batch; the window cuts them by id.
                border = np.partition(scores[:, j], -k)[-k] if len(own) > k else -np.inf
                best = np.flatnonzero(scores[:, j] >= border)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query)), own.take(pa.array(best)), pa.array(scores[best, j])], names=["query_id", "id", "score"])

    if embed:
        small_batches(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    vectors = vectors.where((F.size(vector_col) == matrix.shape[1]) & ~F.exists(vector_col, lambda x: x.isNull())) if len(ids) and not embed else vectors
    return vectors.select(*names).mapInArrow(released(run), f"query_id long, id {kind}, score double")


def ranked(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query with rank from 1."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, id_col: str = "vec_id", vector_col: str = "embedding", allowed: DataFrame | None = None, scope_col: str | None = None) -> DataFrame:
    """query_id, id, score, rank. `allowed` limits the scope before ranking: None is everything, an empty table nothing."""
    if allowed is not None:
        vectors = vectors.join(allowed, scope_col, "left_semi")
    return ranked(score_batches(vectors, queries, max(k, 1), id_col, vector_col), k)


def mmr(pool: DataFrame, k: int, lambda_: float = 0.5) -> DataFrame:
    """query_id, id, score, rank of a greedy choice from each query's pool (query_id, id, relevance, vector).

    Each step takes the largest lambda * relevance - (1 - lambda) * (largest similarity to what is chosen);
    the first penalty is 0. A pool is bounded by the over-fetch, so one query is one small group.
    """
    if not 0 <= lambda_ <= 1:
        raise ValueError("lambda must be from 0 to 1")

    def choose(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("id").to_numpy(),))
        ids, relevance = table.column("id").to_numpy()[order], table.column("relevance").to_numpy()[order]
        made = np.array(table.column("vector").to_pylist(), np.float64)[order]
        alike = rounded(made @ made.T)
        left, penalty, out = np.ones(len(ids), bool), np.zeros(len(ids)), []
        for _ in range(min(k, len(ids))):
            margin = rounded(lambda_ * relevance - (1 - lambda_) * penalty)
            best = int(np.where(left, margin, -np.inf).argmax())
            out.append((ids[best], margin[best]))
            left[best] = False
            penalty = alike[best] if len(out) == 1 else np.maximum(penalty, alike[best])
        return pa.table([pa.array([table.column("query_id")[0].as_py()] * len(out), pa.int64()), pa.array([i for i, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64()), pa.array(range(1, len(out) + 1), pa.int32())], names=["query_id", "id", "score", "rank"])

    return pool.groupBy("query_id").applyInArrow(choose, "query_id long, id long, score double, rank int")
