"""Centroid clustering of whole-number vectors by exponion search.

Components become floor(1024 * x). A vector keeps its cluster, an upper bound of the distance to its
centroid and a lower bound of that to any other. Between rounds the bounds move by as much as centroids
did. Where they don't prove that the centroid is still the only nearest, its distance is taken anew, and
then only centroids in a ball around it are looked at: the vector's second nearest centroid is at most
twice the vector's distance, plus that of the nearest other centroid, away from the first. Centroids of the
ball are a prefix of the centroid's sorted list of distances to others; the radius is inclusive, so ties are
seen and go to the smaller number. Squared distances are exact whole numbers; bounds are widened by rounding.

Vectors travel in blocks with their bounds. Each round reads the blocks and writes them anew in the shared
folder: no shuffle, and a lost executor costs the blocks it was at. Sums change by the vectors that moved.

Left out are vectors that are null, have another length, or a null or non-finite component or one of 2**17 and
more (so that squared distances fit a long). Ids may be null and repeat. Without any vector the result is
empty; with fewer than k there are as many centroids. Other columns are left out. Inertias that don't fit a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, released, small_table, written
from .integers import SCALE, scaled

#: Vectors in a block.
BLOCK = 4096
LIMIT = 2.0**27
#: Widens bounds by more than the rounding of a root and a few sums.
SLACK = 1e-9
BLOCKS = "ids binary, nulls binary, packed binary, cluster binary, upper binary, lower binary, changes binary"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4.0 * float(most) ** 2 * x.shape[1] < 2.0**53:  # whole numbers that doubles hold
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Centroids:
    """Centroids with, for each, the others by distance, and how far each has moved."""

    def __init__(self, rows: np.ndarray, before: np.ndarray | None = None):
        self.rows = rows
        apart = np.sqrt(squared(rows, rows).astype(np.float64))
        np.fill_diagonal(apart, -1)  # first of its own list
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.maximum(np.take_along_axis(apart, self.order, axis=1), 0)
        self.nearest = self.apart[:, 1] if len(rows) > 1 else np.full(1, np.inf)
        moved = np.zeros(len(rows)) if before is None else np.sqrt((((rows - before).astype(np.float64)) ** 2).sum(axis=1))
        self.moved = moved * (1 + SLACK)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New clusters and bounds of the rows `x`, and how many distances that took; cluster -1 has no bounds yet."""
        cluster, upper, lower, taken = cluster.copy(), upper.copy(), lower.copy(), 0
        new = cluster < 0
        known = np.flatnonzero(~new)
        if len(known):
            own = cluster[known]
            most = np.argmax(self.moved)
            others = np.where(own == most, np.delete(self.moved, most).max(initial=0), self.moved[most])
            upper[known] += self.moved[own]
            lower[known] = (lower[known] - others) * (1 - SLACK) - SLACK
            safe = np.maximum(lower[known], self.nearest[own] / 2 * (1 - SLACK))
            open_ = known[upper[known] >= safe]
            taken += len(open_)
            own = cluster[open_]
            off = x[open_] - self.rows[own]
            upper[open_] = np.sqrt((off * off).sum(axis=1).astype(np.float64)) * (1 + SLACK)
            safe = np.maximum(lower[open_], self.nearest[own] / 2 * (1 - SLACK))
            known = open_[upper[open_] >= safe]
        for a in np.unique(cluster[known]) if len(known) else ():
            rows = known[cluster[known] == a]
            radius = (2 * upper[rows] + self.nearest[a]) * (1 + SLACK) + SLACK
            reach = np.searchsorted(self.apart[a], radius, side="right")
            for count in np.unique(reach):
                taken += self._nearest(x, rows[reach == count], np.sort(self.order[a][: max(count, min(2, len(self.rows)))]), cluster, upper, lower)
        if new.any():
            taken += self._nearest(x, np.flatnonzero(new), np.arange(len(self.rows)), cluster, upper, lower)
        return cluster, upper, lower, taken

    def _nearest(self, x: np.ndarray, rows: np.ndarray, among: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Assign `rows` by their distances to the centroids `among`, which are in rising order: the first of equals wins."""
        d = squared(x[rows], self.rows[among])
        cluster[rows] = among[d.argmin(axis=1)]
        two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)) if len(among) > 1 else np.c_[np.sqrt(d.astype(np.float64)), np.full(len(rows), np.inf)]
        upper[rows], lower[rows] = two[:, 0] * (1 + SLACK), two[:, 1] * (1 - SLACK)
        return d.size


def _changes(x: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> bytes:
    """By how much counts (first column) and sums of the clusters change."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    moved = np.flatnonzero(old != new)
    own = np.c_[np.ones(len(moved), np.int64), x[moved]]
    for sign, of in ((1, new[moved]), (-1, old[moved])):
        for j in np.unique(of[of >= 0]):
            out[j] += sign * own[of == j].sum(axis=0)
    return out.tobytes()


def _block(ids: np.ndarray, nulls: np.ndarray, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, changes: bytes) -> pa.RecordBatch:
    fields = (ids.tobytes(), nulls.tobytes(), x.astype("<i4").tobytes(), cluster.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes(), changes)
    return pa.RecordBatch.from_arrays([pa.array([f], pa.binary()) for f in fields], names=NAMES)


def _blocks(rows: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """The vectors of (id, vector) rows in blocks, assigned for the first time."""
    k = len(centroids.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            ids, nulls, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            none = np.full(len(x), -1)
            cluster, upper, lower, _ = centroids.assign(x, none, np.zeros(len(x)), np.zeros(len(x)))
            return _block(ids, nulls, x, cluster, upper, lower, _changes(x, none, cluster, k))

        for batch in batches:
            ids, nulls = batch.column(0).fill_null(0).to_numpy(), np.asarray(batch.column(0).is_null())
            for at, x in scaled(batch.column(1), LIMIT):
                if x.shape[1] != dims:
                    continue
                for j in range(0, len(at), BLOCK):
                    own = at[j : j + BLOCK]
                    held.append((ids[own], nulls[own], x[j : j + BLOCK]))
                    if sum(len(h[0]) for h in held) >= BLOCK:
                        yield made()
        if held:
            yield made()

    return rows.mapInArrow(released(run), BLOCKS)


def _parts(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, ...]]:
    for row in zip(*(batch.column(j) for j in range(6)), strict=True):
        ids, nulls, packed, cluster, upper, lower = (c.as_py() for c in row)
        yield np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), np.frombuffer(packed, "<i4").reshape(-1, dims).astype(np.int64), np.frombuffer(cluster, "<i4").astype(np.int64), np.frombuffer(upper), np.frombuffer(lower)


def _again(blocks: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """The blocks after one more assignment."""
    k = len(centroids.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nulls, x, old, upper, lower in _parts(batch, dims):
                cluster, upper, lower, _ = centroids.assign(x, old, upper, lower)
                yield _block(ids, nulls, x, cluster, upper, lower, _changes(x, old, cluster, k))

    return blocks.mapInArrow(released(run), BLOCKS)


def _added(blocks: DataFrame, k: int, dims: int) -> np.ndarray:
    """The sum of all changes, of whole numbers of any size: k rows of a count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (dims + 1), np.int64)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "x"])

    out = np.zeros(k * (dims + 1), object)
    for row in blocks.select("changes").mapInArrow(run, "at long, x long").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[row.at] = int(row.x)
    return out.reshape(k, dims + 1)


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector of doubles takes part."""
    return (F.size(vector) == dims) & F.forall(vector, lambda x: F.abs(x) < LIMIT / SCALE)


def _first(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    whole = F.transform("vector", lambda x: F.floor(SCALE * x))
    found = rows.select(F.sha2(name, 256).alias("hash"), whole.alias("x")).orderBy("hash", "x").limit(k).collect()
    return np.array([r.x for r in found], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector"), dims))
    first = _first(rows, k, seed)
    if not len(first):
        return _empty(spark)
    now, total, blocks = Centroids(first), np.zeros((len(first), dims + 1), object), None
    for _ in range(rounds):
        blocks = _step(blocks, rows, now, dims)
        total = total + _added(blocks, len(first), dims)
        moved = np.array([[s // int(t[0]) for s in t[1:]] if t[0] else c.tolist() for t, c in zip(total, now.rows, strict=True)], np.int64)
        if np.array_equal(moved, now.rows):  # nothing changes in the rounds that are left
            now = Centroids(moved, now.rows)
            break
        now = Centroids(moved, now.rows)
    final = _step(blocks, rows, now, dims)
    out = written(_distances(final, now, dims), "distances")
    discard(final)
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = sum(int(r.s) for r in sums)
    fits = lambda s: s if s < 2**63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.rows.tolist()]
    of = small_table(spark, [{"c": r.cluster, "cluster_inertia": fits(int(r.s)), "inertia": fits(whole), "centroid_sha256": shas[r.cluster]} for r in sums], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of), F.col("cluster") == F.col("c")).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _step(blocks: DataFrame | None, rows: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """All blocks assigned to `centroids` and written; the blocks before are removed."""
    out = written(_blocks(rows, centroids, dims) if blocks is None else _again(blocks, centroids, dims), "blocks")
    if blocks is not None:
        discard(blocks)
    return out


def _distances(blocks: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nulls, x, of, _, _ in _parts(batch, dims):
                off = x - centroids.rows[of]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(of.astype(np.int32)), pa.array((off * off).sum(axis=1))], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(released(run), "id long, cluster int, distance long")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
