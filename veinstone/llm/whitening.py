"""Embedding whitening by a one-sided Jacobi SVD of a blockwise TSQR.

Every component c of a vector becomes the whole number x = floor(1024 * c) + offset. The fit list is all
vectors that take part. Their sums S are exact, and n * x - S is exact for each row before it is divided
by n. Each task compresses its centred rows to a triangle R, block by block; triangles are merged in a
tree by further QR steps. In the last task plane rotations make the columns of R orthogonal: then the
columns' lengths are the singular values, and the rotations, accumulated, are the components. No
covariance is ever formed for them, so small deviations keep their digits.

Left out are vectors that are null, empty, hold a null or non-finite entry, or one of 2**62 / 1024 and
more, and those of another length than most have (ties: the longer). Ids may be null and repeat; every row is its own.
A component without variance has null as whitened value, and is not in identity_error; if no component
has any, explained is null. deviation is null where it doesn't fit a long. Other columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, released, written
from .integers import merged, scaled

LIMIT = 2.0**62
#: Singular values below this share of the largest are rounding.
RANK = 1e-12
LONG = 2**63 - 1


class Whitening(NamedTuple):
    """n vectors with the exact sums `sums`; components in rows, by falling standard deviation; explained: shares of all variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    offset: int


def rotated(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors in columns) of `r` by one-sided Jacobi.

    A sweep visits every pair of columns once, half of the columns' number at a time, which touch each
    other's columns nowhere and so are one array operation.
    """
    a, d = r.astype(np.float64), r.shape[1]
    v = np.eye(d)
    small = np.sqrt(d) * np.finfo(np.float64).eps
    even = d + d % 2
    ring = np.arange(even)
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            need = np.abs(gamma) > small * np.sqrt(alpha * beta)
            if need.any():
                turned = True
                p, q, gamma = p[need], q[need], gamma[need]
                with np.errstate(over="ignore"):  # columns far from each other hardly turn
                    zeta = (beta[need] - alpha[need]) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                for m in (a, v):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            ring = np.r_[ring[0], ring[-1], ring[1:-1]]
        if not turned:
            break
    values = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


def _sums(vectors: DataFrame, offset: int) -> tuple[int, list[int]]:
    """How many vectors have the commonest length, and the exact sum of each of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in scaled(batch.column(1), LIMIT):
                x += offset
                n, high, low = held.get(x.shape[1], (0, 0, 0))
                held[x.shape[1]] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
        for d, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["dims", "pos", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = vectors.mapInArrow(run, "dims long, pos long, n long, high long, low long")
    sums = written(parts.groupBy("dims", "pos").agg(F.sum("n").alias("n"), exact("high"), exact("low")), "sums")
    most = sums.where("pos = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    rows = sums.where(F.col("dims") == most[0].dims).orderBy("pos").collect() if most else []
    discard(sums)
    return (most[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]) if rows else (0, [])


def _off(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: longs, or Python's whole numbers where longs may not do."""
    about = np.abs(x.astype(np.float64) * n - np.array([float(s) for s in sums]))
    if about.max(initial=0) < 2.0**62:  # arithmetic modulo 2**64 gives the right long
        own = np.array([s % 2**64 for s in sums], np.uint64)
        return (x.view(np.uint64) * np.uint64(n) - own).view(np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(batch: pa.RecordBatch, n: int, sums: tuple[int, ...], offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the batch and n * x - S of the vectors that take part."""
    for rows, x in scaled(batch.column(1), LIMIT):
        if x.shape[1] == len(sums):
            return rows, _off(x + offset, n, sums)
    return np.empty(0, np.int64), np.empty((0, len(sums)), np.int64)


def fit(vectors: DataFrame, components: int = 8, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all vectors that take part; None if there are none."""
    rows = _two(vectors, id_col, vector_col)
    n, total = _sums(rows, offset)
    if not n:
        return None
    sums, d = tuple(total), len(total)

    def triangle(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r = np.empty((0, d))
        for batch in batches:
            off = _centred(batch, n, sums, offset)[1]
            if len(off):
                r = np.linalg.qr(np.vstack([r, off.astype(np.float64) / n]), mode="r")
        return r.tobytes() if len(r) else None

    square = lambda b: np.frombuffer(b, np.float64).reshape(-1, d)
    r = merged(rows, triangle, lambda x, y: np.linalg.qr(np.vstack([square(x), square(y)]), mode="r").tobytes())
    values, v = rotated(square(r))
    k, spread = min(components, d), float((values**2).sum())
    return Whitening(n, sums, np.ascontiguousarray(v[:, :k].T), values[:k] / np.sqrt(n), values[:k] ** 2 / spread if spread else np.full(k, np.nan), offset)


def _two(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))


def _project(off: np.ndarray, model: Whitening) -> np.ndarray:
    """The whitened values of centred rows; NaN for components without variance."""
    firm = model.deviations > RANK * model.deviations[0]
    out = np.full((len(off), len(firm)), np.nan)
    if len(off):
        out[:, firm] = (off.astype(np.float64) / model.n) @ (model.components[firm] / model.deviations[firm, None]).T
    return out


def identity_error(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity."""
    firm = model.deviations > RANK * model.deviations[0]
    k = int(firm.sum())

    def join(x: bytes, y: bytes) -> bytes:
        (n, mx, cx), (m, my, cy) = moments(x), moments(y)
        step = my - mx
        return np.r_[n + m, mx + step * (m / (n + m)), (cx + cy + np.outer(step, step) * (n * m / (n + m))).ravel()].tobytes()

    def moments(part: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        flat = np.frombuffer(part, np.float64)
        return flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    def part(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        whole = None
        for batch in batches:
            white = _project(_centred(batch, model.n, model.sums, model.offset)[1], model)[:, firm]
            if len(white):
                mean = white.mean(axis=0)
                own = np.r_[len(white), mean, ((white - mean).T @ (white - mean)).ravel()].tobytes()
                whole = own if whole is None else join(whole, own)
        return whole

    made = merged(_two(vectors, id_col, vector_col), part, join) if k else None
    if made is None:
        return None
    n, _, c = moments(made)
    return float(np.abs(c / n - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (exact sum of (n*x - S)**2), whitened and explained: a row for each vector and component."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, off = _centred(batch, model.n, model.sums, model.offset)
            if len(rows):
                if off.dtype != object and len(model.sums) * float(np.abs(off).max()) ** 2 < 2.0**62:
                    apart = (off * off).sum(axis=1)
                else:
                    apart = [s if s <= LONG else None for s in (sum(int(e) ** 2 for e in row) for row in off)]
                white = _project(off, model).ravel()
                columns = [batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)))]
                columns += [pa.array(apart, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(white, mask=np.isnan(white)), pa.array(np.tile(model.explained, len(rows)), mask=np.isnan(np.tile(model.explained, len(rows))))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "deviation", "whitened", "explained"])

    made = _two(vectors, id_col, vector_col).mapInArrow(released(run), "id long, component int, deviation long, whitened double, explained double")
    return made.select(F.col("id").alias("vec_id"), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained")


def whiten(vectors: DataFrame, components: int = 8, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """transform() with the fit of the same vectors, and identity_error."""
    model = fit(vectors, components, offset, id_col, vector_col)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, model, id_col, vector_col)
    return transform(vectors, model, id_col, vector_col).withColumn("identity_error", F.lit(error).cast("double"))
