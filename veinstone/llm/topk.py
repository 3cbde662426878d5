"""Exact top-k search by an impact-ordered index, processed score at a time.

Vectors are quantised to integers, floor(scale * x). The index of a block of candidates has, for each
dimension, its postings ordered by impact (the component, in steps of `step`), so that equal impacts
are a segment. A query multiplies a segment's impact by its own component: that is what the segment
can contribute at most. Segments of all dimensions are processed by descending contribution, in rounds
with falling thresholds t. After a round, a candidate that has c of d dimensions processed, with sum s,
can still reach s + (d - c) * t at most. The k-th best exact score among the leading candidates is
a proof against all that can't reach it (ties can matter, so only lower bounds are out). When few
possible members are left, or no segment is, they are rescored exactly.

Vectors take no part, neither as queries nor as candidates, if they are null or empty or hold a null or a
non-finite component. Only vectors of equal dimension meet. A query is a row, and every other row is a candidate, one
that repeats its id or all of it included; rows with one query id give a list each. A null id can be found, and
comes after all others of its score. Ties go to the smaller vec_id. Where products might not fit in 64
bits, scores are added up as whole numbers of any length; one beyond a long is given as the nearest long, and
ranks as that. Columns other than the id and the vector are left out, so none can clash. An empty table gives an empty result.

Scale: rows are packed into blocks where they are read, and each block's index is built once and written. Queries are
sent in chunks of at most `chunk_bytes`; for each chunk all blocks are read where they lie, and a task keeps
only the k best of each query over all its blocks, whose k-th is a bound for its next block. So vectors are never
shuffled, and only the tasks' k best are, for a ranked window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import mul
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
#: How many integers count as one impact.
STEP = 16
#: The thresholds, in typical contributions (root mean square); the last round takes what is left.
FALL = (0.4, 0.0, -0.4, -1.0, -2.0)


class ImpactIndex:
    """Postings of a block of integer vectors, by dimension and rising impact."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, step: int = STEP):
        self.vectors, self.order = vectors, order
        self.low = np.take_along_axis(np.floor_divide(vectors, step).T, order.astype(np.int64), axis=1) * step
        self.high = self.low + (step - 1)
        self.spread = float(np.sqrt(np.mean(vectors.astype(np.float64) ** 2)))

    @staticmethod
    def ordered(vectors: np.ndarray, step: int = STEP) -> np.ndarray:
        """The places of the vectors by impact, for each dimension."""
        return np.argsort(np.floor_divide(vectors, step).T, axis=1, kind="stable").astype(np.int32)

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The places and scores of at least all candidates but the one at place `own` that are among the k best and reach `floor`."""
        n, dims = self.vectors.shape
        by_dim = query.tolist()
        most = lambda d, k: by_dim[d] * int(self.high[d, k] if by_dim[d] > 0 else self.low[d, k])
        top = max(max(most(d, 0), most(d, n - 1)) for d in range(dims))
        bottom = min(min(most(d, 0), most(d, n - 1)) for d in range(dims))
        # One sum holds what was added up and, in its lowest bits, how many dimensions were; two do if that might overflow.
        shift = dims.bit_length()
        if max(abs(top), abs(bottom)) * dims >= 1 << (62 - shift):
            shift = 0
        done, total, seen = [0] * dims, np.zeros(n, np.int64), np.zeros(n if not shift else 0, np.int64)
        possible = np.delete(np.arange(n), own) if 0 <= own < n else np.arange(n)
        spread = self.spread * float(np.sqrt(np.mean(query.astype(np.float64) ** 2)))
        for r in range(len(FALL) + 1):
            t = bottom if r == len(FALL) else max(bottom, int(FALL[r] * spread))
            for d, q in enumerate(by_dim):
                # Rising components give falling contributions if q is negative; else the list is read from its end.
                if q < 0:
                    end = int(np.searchsorted(self.low[d], t // q, side="right"))
                    own = slice(done[d], end)
                    bound = self.low[d, own]
                else:
                    end = n - int(np.searchsorted(self.high[d], -(-t // q), side="left")) if q else n * (t <= 0)
                    own = slice(n - end, n - done[d])
                    bound = self.high[d, own]
                if end <= done[d]:
                    continue
                done[d] = end
                if shift:
                    total[self.order[d, own]] += bound * (q << shift) + 1
                else:
                    total[self.order[d, own]] += bound * q
                    seen[self.order[d, own]] += 1
            reach = (total >> shift) + (dims - (total & ((1 << shift) - 1))) * t if shift else total + (dims - seen) * t
            possible = possible[reach[possible] >= floor] if floor is not None else possible
            if len(possible) <= 4 * k:
                break
            if r % 2 == 0:
                lead = possible[np.argpartition(-reach[possible], 4 * k)[: 4 * k]]
                exact = self.vectors[lead] @ query
                bound = int(np.partition(exact, len(exact) - k)[len(exact) - k])
                floor = bound if floor is None else max(floor, bound)
                possible = possible[reach[possible] >= floor]
            if len(possible) <= max(8 * k, n // 8):
                break
        return possible, self.vectors[possible] @ query


class Block(NamedTuple):
    """Vectors that were read together; `values` are integers, or the components themselves where those don't fit in 32 bits."""

    ids: np.ndarray
    null: np.ndarray
    values: np.ndarray
    index: ImpactIndex | None
    most: int

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, list[int] | np.ndarray]:
        dims = self.values.shape[1]
        if self.index is not None and query.dtype != np.float64 and dims * self.most * int(np.abs(query).max()) < 1 << 61:
            return self.index.search(own, query, k, floor)
        left, right = ([[_whole(x) for x in v] for v in m.tolist()] if m.dtype == np.float64 else m.tolist() for m in (self.values, query[None, :]))
        scores = [min(max(sum(map(mul, v, right[0])), LEAST), MOST) for v in left]
        places = np.array([p for p in range(len(scores)) if p != own], np.int64)
        return places, np.array([scores[p] for p in places], np.int64)


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _whole(x: float) -> int:
    """floor(SCALE * x) exactly, also where the product is beyond a double."""
    return int(np.floor(SCALE * x)) if abs(x) < 2.0**53 else SCALE * int(x)


BLOCKS = "block long, dims int, wide boolean, ids binary, nulls binary, asked binary, packed binary, places binary"


def blocks(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, block_rows: int) -> DataFrame:
    """The vectors that take part, packed with their index: up to `block_rows` of one dimension in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        held: dict[tuple[int, bool], list] = {}

        def made(key: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal name
            rows = held.pop(key)
            ids, asked = [i for i, _, _ in rows], np.array([bool(a) for _, a, _ in rows])
            values = np.stack([v for _, _, v in rows])
            if not key[1]:
                values = np.floor(SCALE * values).astype("<i4")
            places = b"" if key[1] else ImpactIndex.ordered(values.astype(np.int64)).tobytes()
            name += 1
            fields = (name, key[0], key[1], np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(), asked.tobytes(), values.tobytes(), places)
            return pa.RecordBatch.from_pylist([dict(zip(("block", "dims", "wide", "ids", "nulls", "asked", "packed", "places"), fields, strict=True))], schema=SCHEMA)

        for batch in batches:
            for vec_id, asked, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = vector.values
                if values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                key = (len(x), bool(np.abs(x).max() >= 2.0**31 / SCALE))
                rows = held.setdefault(key, [])
                rows.append((vec_id, asked, x))
                if len(rows) >= (block_rows if not key[1] else max(1, block_rows // 16)):
                    yield made(key)
        for key in list(held):
            yield made(key)

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return own.select("id", is_query.alias("asked"), "vector").mapInArrow(run, BLOCKS)


SCHEMA = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("wide", pa.bool_()), ("ids", pa.binary()), ("nulls", pa.binary()), ("asked", pa.binary()), ("packed", pa.binary()), ("places", pa.binary())])


def _values(packed: bytes, dims: int, wide: bool) -> np.ndarray:
    return np.frombuffer(packed, np.float64).reshape(-1, dims) if wide else np.frombuffer(packed, "<i4").reshape(-1, dims).astype(np.int64)


def _queries(table: DataFrame) -> DataFrame:
    """block, at, id, dims, wide and packed of each query row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["asked"], bool))
                ids, size = np.frombuffer(row["ids"], np.int64), row["dims"] * (8 if row["wide"] else 4)
                n = len(at)
                columns = [pa.array([row["block"]] * n, pa.int64()), pa.array(at), pa.array(ids[at]), pa.array([row["dims"]] * n, pa.int32()), pa.array([row["wide"]] * n, pa.bool_()), pa.array([row["packed"][k * size : (k + 1) * size] for k in at.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "id", "dims", "wide", "packed"])

    return table.select("block", "dims", "wide", "ids", "asked", "packed").mapInArrow(run, "block long, at long, id long, dims int, wide boolean, packed binary")


def _found(table: DataFrame, queries: list, k: int) -> DataFrame:
    """The k best of each query in each task's blocks; `queries` is one chunk."""
    sent = table.sparkSession.sparkContext.broadcast([(r.block, r.at, r.dims, r.wide, bytes(r.packed)) for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(block, at, dims, _values(packed, dims, wide)[0]) for block, at, dims, wide, packed in sent.value]
        best: list[tuple[np.ndarray, ...] | None] = [None] * len(asked)
        for batch in batches:
            for row in batch.to_pylist():
                values = _values(row["packed"], row["dims"], row["wide"])
                index = None if row["wide"] else ImpactIndex(values, np.frombuffer(row["places"], np.int32).reshape(row["dims"], -1))
                own = Block(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), values, index, int(np.abs(values).max()) if index else 0)
                for q, (block, at, dims, query) in enumerate(asked):
                    if dims != row["dims"]:
                        continue
                    held = best[q]
                    floor = int(held[0][-1]) if held is not None and len(held[0]) == k else None
                    places, scores = own.search(at if block == row["block"] else -1, query, k, floor)
                    new = (np.asarray(scores, np.int64), own.null[places], own.ids[places])
                    if held is not None:
                        new = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                    # Complement instead of a minus sign, as the least long has no opposite.
                    top = np.lexsort((new[2], new[1], ~new[0]))[:k]
                    best[q] = tuple(x[top] for x in new)
        for q, held in enumerate(best):
            if held is not None and len(held[0]):
                n = len(held[0])
                yield pa.RecordBatch.from_arrays([pa.array([asked[q][0]] * n, pa.int64()), pa.array([asked[q][1]] * n, pa.int64()), pa.array(held[2], mask=held[1]), pa.array(held[0])], names=["block", "at", "vec_id", "score"])

    return table.select("block", "dims", "wide", "ids", "nulls", "packed", "places").mapInArrow(run, "block long, at long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16384, chunk_bytes: int = 1 << 25) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the k best of all other rows for each row where `is_query` (over column `id`)."""
    table = written(blocks(vectors, is_query, id_col, vector_col, block_rows), "blocks")
    queries = written(_queries(table), "queries")
    size = queries.agg(F.sum(F.octet_length("packed") + 64).alias("size")).first().size or 0
    chunks = -(-size // chunk_bytes)
    made = []
    for c in range(chunks):
        part = queries if chunks == 1 else queries.where(F.pmod(F.xxhash64("block", "at"), F.lit(chunks)) == c)
        made.append(written(_found(table, part.collect(), k), "found"))
    ids = queries.select(F.col("block").alias("b"), F.col("at").alias("a"), F.col("id").alias("query_id"))
    found = reduce(DataFrame.unionByName, made) if made else table.select("block", F.col("block").alias("at"), F.col("block").alias("vec_id"), F.col("block").alias("score")).where(F.lit(False))
    rank = F.row_number().over(Window.partitionBy("block", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(ids, (F.col("block") == F.col("b")) & (F.col("at") == F.col("a"))).select("query_id", "rank", "vec_id", "score")
