"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors are dealt to overlapping shards: each is a node of its `overlap` nearest centroids' shards. In
each shard a graph is built: a node's candidates by falling similarity, of which robust pruning drops
those that a kept one is nearer to by the factor alpha. The adjacency lists of a node from all its shards are
united. Then every vector is searched for in its own shards and in all others whose centroid is nearly as
near (`reach`): a beam goes from the shard's medoid over the united lists, and the range around what
it found is expanded by following the neighbours of all nodes whose similarity is at least the
threshold less a slack. A search whose range has spread over an eighth of a shard takes the rest of the
shard as one block. Links are verified in double precision. Each vector is found in its nearest shard only,
so that no link counts twice.

The recall is audited against brute force for a bounded number of vectors, by links and by vectors. If
it is below the aim, the reach is doubled and the searches run again; the last reach takes every
shard as one block, which is brute force, so no loss is ever returned for want of a better way.

Centroids: k-means on a bounded sample gives up to `max_centroids` cells. Cells that are still too large
are divided by k-means of their own, on the executors, so that shards keep their size however many
vectors there are. Equal vectors are one node, so that thousands of copies don't fill a shard; the copies
of a node link with each other. Shards that are still above `shard_limit` are split by hash, each part with
a graph of its own that all searches visit; searches are dealt in chunks. So no task grows, and links
leave it as counts and as a spanning forest, never as all pairs.

Null vectors, zero vectors and vectors with a null or non-finite component link with nothing; vectors
of different dimensions don't link either. Every input row gives a row. Rows with one id and one vector
are one vector; rows with one id and different vectors are linked each for itself, under that id. A null
id is a vector of its own in every row; ids of components don't count nulls (null if all are), and a null
id is kept only if its component's is null. Columns other than the id and the vector are left out, so
none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import connected_components, spanning

SLACK = 0.1
#: Searches that advance together.
BLOCK = 1024


def unit(batch: np.ndarray) -> np.ndarray:
    """Rows of length 1; a first division by the largest component keeps squares finite."""
    batch = batch / np.abs(batch).max(axis=1, keepdims=True)
    return batch / np.sqrt((batch * batch).sum(axis=1, keepdims=True))


def robust_prune(similar: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each node out of its candidates (n x degree, filled up with the node itself)."""
    n = len(similar)
    rows, distance = np.arange(n), 2.0 - 2.0 * similar
    own = np.where(candidates == rows[:, None], np.inf, np.take_along_axis(distance, candidates, axis=1))
    order = np.argsort(own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(own, order, axis=1)
    alive, out = own < np.inf, np.tile(rows[:, None], (1, degree))
    for k in range(degree):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        best = candidates[rows, pick]
        out[some, k] = best[some]
        # What the kept neighbour is nearer to, by alpha, is reached through it.
        alive &= alpha * distance[best[:, None], candidates] > own
        alive[rows, pick] = False
    return out


def graph_of(vectors: np.ndarray, degree: int, far: int, pool: int, alpha: float) -> np.ndarray:
    """The lists of a shard: `degree` pruned out of the `pool` nearest nodes, and `far` out of as many at random, without which a
    tight group larger than the pool would have no way out, nor the medoid one that lies in it."""
    n = len(vectors)
    similar = vectors @ vectors.T
    pool = min(pool, n)
    near = np.argpartition(-similar, pool - 1, axis=1)[:, :pool] if pool < n else np.tile(np.arange(n), (n, 1))
    some = np.random.default_rng(0).integers(0, n, (n, pool))
    return np.concatenate([robust_prune(similar, near, degree, alpha), robust_prune(similar, some, far, 1.0)], axis=1)


def search_shard(queries: np.ndarray, vectors: np.ndarray, graph: np.ndarray, threshold: float, slack: float = SLACK, beam: int = 12, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of similarity `threshold` or more that the searches find, each pair once.

    `graph` has the neighbours of each node, filled up with itself. `whole` takes the shard as one block at once.
    """
    n, rough = len(vectors), vectors.astype(np.float32)
    medoid = int((vectors @ vectors.mean(axis=0)).argmax())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for begin in range(0, len(queries), BLOCK):
        own = queries[begin : begin + BLOCK]
        q, to = _expand(own.astype(np.float32), rough, graph, medoid, threshold, slack, beam) if not whole else (np.empty(0, np.int64),) * 2
        dense = np.flatnonzero(np.bincount(q, minlength=len(own)) * 8 > n) if not whole else np.arange(len(own))
        sparse = ~np.isin(q, dense)
        code = np.unique(q[sparse] * n + to[sparse])
        q, to = code // n, code % n
        exact = np.einsum("kd,kd->k", own[q], vectors[to]) >= threshold
        found.append((q[exact] + begin, to[exact]))
        for k in range(0, len(dense), 256):
            i, j = np.nonzero(own[dense[k : k + 256]] @ vectors.T >= threshold)
            found.append((dense[k : k + 256][i] + begin, j))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def _expand(queries: np.ndarray, vectors: np.ndarray, graph: np.ndarray, medoid: int, threshold: float, slack: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all nodes visited whose similarity is about `threshold` or more; searches that spread far stop early."""
    m, n, rows = len(queries), len(vectors), np.arange(len(queries))
    seen = np.zeros((m, n), bool)
    seen[:, medoid] = True
    nodes = np.full((m, beam), medoid)
    near = np.full((m, beam), -np.inf, np.float32)
    near[:, 0] = queries @ vectors[medoid]
    open_ = near > -np.inf
    kept_q, kept_to, kept_s = [rows], [nodes[:, 0].copy()], [near[:, 0].copy()]
    while True:
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            break
        at = np.where(open_[live], near[live], -np.inf).argmax(axis=1)
        open_[live, at] = False
        around = graph[nodes[live, at]]
        # A list names no neighbour twice, and the node itself, which fills it up, has been seen.
        old = seen[live[:, None], around]
        seen[live[:, None], around] = True
        likeness = np.matmul(vectors[around], queries[live][:, :, None])[:, :, 0]
        likeness[old] = -np.inf
        wide = likeness >= threshold - slack
        a, b = np.nonzero(wide)
        kept_q.append(live[a])
        kept_to.append(around[a, b])
        kept_s.append(likeness[a, b])
        merged = np.concatenate([near[live], likeness], axis=1)
        best = np.argpartition(-merged, beam - 1, axis=1)[:, :beam]
        near[live] = np.take_along_axis(merged, best, axis=1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], around], axis=1), best, axis=1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], likeness > -np.inf], axis=1), best, axis=1)
    q, to, s = (np.concatenate(x) for x in (kept_q, kept_to, kept_s))
    wide = s >= threshold - slack
    q, to, s = q[wide], to[wide], s[wide]
    all_q, all_to, all_s = [q], [to], [s]
    reached = np.bincount(q, minlength=m)
    while len(q):
        go = reached[q] * 8 <= n  # the others become one block
        q, to = q[go], to[go]
        next_q, next_to = [], []
        for k in range(0, len(q), 8192):
            eq = np.repeat(q[k : k + 8192], graph.shape[1])
            et = graph[to[k : k + 8192]].ravel()
            fresh = ~seen[eq, et]
            code = np.unique(eq[fresh] * n + et[fresh])
            eq, et = code // n, code % n
            seen[eq, et] = True
            for b in range(0, len(eq), 65536):
                likeness = np.einsum("kd,kd->k", queries[eq[b : b + 65536]], vectors[et[b : b + 65536]])
                wide = likeness >= threshold - slack
                next_q.append(eq[b : b + 65536][wide])
                next_to.append(et[b : b + 65536][wide])
                all_s.append(likeness[wide])
        q = np.concatenate(next_q) if next_q else np.empty(0, np.int64)
        to = np.concatenate(next_to) if next_to else np.empty(0, np.int64)
        all_q.append(q)
        all_to.append(to)
        reached += np.bincount(q, minlength=m)
    q, to, s = (np.concatenate(x) for x in (all_q, all_to, all_s))
    # What float32 may have rounded down stays for the check in double precision; searches to be done as a block keep their counts.
    close = (s >= threshold - 1e-4) | (reached[q] * 8 > n)
    return q[close], to[close]


def centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means; `sample` has unit rows."""
    rng = np.random.default_rng(seed)
    made = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 8192] @ made.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(made)
        np.add.at(sums, own, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        made = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], made)
    return made


class Settings(NamedTuple):
    """Near and far neighbours of a node, pruning factor and candidates; nodes aimed at and allowed in a shard, searches in a
    task; bounds of the k-means; vectors audited, shards of each node, first reach and the recall aimed at."""

    degree: int = 18
    far: int = 6
    alpha: float = 1.44  # of squared distances
    pool: int = 54
    shard_rows: int = 1000
    shard_limit: int = 4000
    chunk_rows: int = 20_000
    max_centroids: int = 2048
    sample_per_centroid: int = 40
    audited: int = 500
    overlap: int = 2
    reach: float = 0.05
    aim: float = 0.97


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dims and packed (unit vector, float64) of every row; the latter null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            lengths[np.asarray(column.is_null())] = 0
            begins = column.offsets.to_numpy()[:-1]
            values = column.values
            flat, null = values.to_numpy(zero_copy_only=False), np.asarray(values.is_null())
            packed: list[bytes | None] = [None] * batch.num_rows
            for d in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == d)
                at = begins[rows][:, None] + np.arange(d)
                made = flat[at].astype(np.float64)
                good = np.isfinite(made).all(axis=1) & made.any(axis=1) & ~null[at].any(axis=1)
                for k, v in zip(rows[good], unit(made[good]) if good.any() else (), strict=True):
                    packed[k] = v.tobytes()
            dims = [None if p is None else len(p) // 8 for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["id", "dims", "packed"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "id long, dims int, packed binary")


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


HOME, NODE, SEARCH = 4, 2, 1


def _visits(likeness: np.ndarray, reach: float, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centroid, place) of the centroids to visit. Place has bits: HOME for the nearest, NODE for the `overlap` nearest, SEARCH for those in reach of the nearest."""
    k = min(overlap, likeness.shape[1])
    nearest = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    place = np.where(likeness >= likeness.max(axis=1, keepdims=True) - reach, SEARCH, 0)
    np.put_along_axis(place, nearest, np.take_along_axis(place, nearest, axis=1) | NODE, axis=1)
    place[np.arange(len(place)), likeness.argmax(axis=1)] = HOME | NODE | SEARCH
    row, at = np.nonzero(place)
    return row, at, place[row, at]


VISIT = "dims int, shard long, place int, node long, copies long, packed binary"


def _routed(batch: pa.RecordBatch, row: np.ndarray, shard: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A batch of visits from node, dims, copies, packed of `batch`."""
    part = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays([part.column(1), pa.array(shard.astype(np.int64)), pa.array(place.astype(np.int32)), part.column(0), part.column(2), part.column(3)], names=["dims", "shard", "place", "node", "copies", "packed"])


class Cells(NamedTuple):
    """Centroids of the first level, by dimension, and a table of those of the cells that are divided (or None)."""

    first: dict[int, np.ndarray]
    second: DataFrame | None


def _train(nodes: DataFrame, s: Settings) -> Cells:
    """K-means on bounded samples by hash; cells of more than twice shard_rows are divided if there are more than max_centroids shards."""
    made, deep = {}, False
    for row in nodes.groupBy("dims").agg(F.count("*").alias("n")).collect():
        k = -(-row.n * s.overlap // s.shard_rows)
        deep |= k > s.max_centroids
        k = min(k, s.max_centroids)
        share = min(1.0, k * s.sample_per_centroid / row.n)
        sample = nodes.where((F.col("dims") == row.dims) & (F.pmod(F.hash("node", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("packed").collect()
        vectors = np.frombuffer(b"".join(bytes(r.packed) for r in sample), np.float64).reshape(-1, row.dims)
        made[row.dims] = centroids(vectors, min(k, len(vectors))) if len(vectors) else np.eye(1, row.dims)
    if not deep:
        return Cells(made, None)
    homes = written(_first(nodes, made, 0.0, 1).select("dims", "shard", "node", "packed"), "homes")
    sizes = homes.groupBy("dims", "shard").agg(F.count("*").alias("n")).where(F.col("n") * s.overlap > 2 * s.shard_rows)
    sizes = sizes.select(F.col("dims").alias("d"), F.col("shard").alias("c"), F.least(F.ceil(F.col("n") * s.overlap / s.shard_rows), F.lit(s.max_centroids)).alias("k"), "n")
    drawn = F.pmod(F.hash("node", F.lit(4)), F.lit(1 << 30)) < F.col("k") * s.sample_per_centroid / F.col("n") * (1 << 30)
    sample = homes.join(sizes, (F.col("dims") == F.col("d")) & (F.col("shard") == F.col("c"))).where(drawn).select("dims", "shard", "k", "packed")

    def divide(table: pa.Table) -> pa.Table:
        dims, shard, k = (table.column(c)[0].as_py() for c in ("dims", "shard", "k"))
        vectors = _matrix(table.column("packed"), dims)
        return pa.table([pa.array([dims], pa.int32()), pa.array([shard], pa.int64()), pa.array([centroids(vectors, min(k, len(vectors))).tobytes()], pa.binary())], names=["dims", "shard", "matrix"])

    second = written(sample.groupBy("dims", "shard").applyInArrow(divide, "dims int, shard long, matrix binary"), "cells")
    discard(homes)
    return Cells(made, second)


def _first(nodes: DataFrame, made: dict[int, np.ndarray], reach: float, overlap: int) -> DataFrame:
    """The visits of all nodes to the cells of the first level."""
    sent = nodes.sparkSession.sparkContext.broadcast(made)  # max_centroids rows at most per dimension

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                for k in range(0, part.num_rows, 2048):
                    some = part.slice(k, 2048)
                    yield _routed(some, *_visits(_matrix(some.column(3), d) @ sent.value[int(d)].T, reach, overlap))

    return nodes.select("node", "dims", "copies", "packed").mapInArrow(assign, VISIT)


def _second(visits: DataFrame, cells: DataFrame, reach: float, overlap: int) -> DataFrame:
    """The visits to the parts of the cells that are divided; shards get numbers of their own.

    A cell's centroids are sent to each of the salted groups of its visits, ahead of them.
    """
    salts = 16
    ahead = cells.select("dims", "shard", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), F.col("matrix").alias("packed"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = ahead.unionByName(visits.withColumn("salt", F.pmod(F.hash("node"), F.lit(salts)))).repartition("dims", "shard", "salt").sortWithinPartitions("dims", "shard", "salt", "place")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, matrix = None, None
        for batch in batches:
            dims, shard, place, salt = (batch.column(k).to_numpy() for k in (0, 1, 2, 6))
            cuts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]), True])
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                own = (dims[begin], shard[begin], salt[begin])
                if own != key:
                    key, matrix = own, None
                if place[begin] < 0:
                    matrix = np.frombuffer(batch.column(5)[int(begin)].as_py(), np.float64).reshape(-1, own[0])
                    begin += 1
                part = pa.RecordBatch.from_arrays([batch.column(k).slice(begin, end - begin) for k in (3, 0, 4, 5)], names=["node", "dims", "copies", "packed"])
                for k in range(0, part.num_rows, 2048):
                    some = part.slice(k, 2048)
                    above = place[begin + k : begin + k + some.num_rows]
                    if matrix is None:
                        row, at, own_place = np.arange(some.num_rows), np.zeros(some.num_rows, np.int64), np.full(some.num_rows, HOME | NODE | SEARCH)
                    else:
                        row, at, own_place = _visits(_matrix(some.column(3), int(own[0])) @ matrix.T, reach, overlap)
                    yield _routed(some, row, own[1] * (1 << 20) + at, above[row] & own_place)

    return dealt.select("dims", "shard", "place", "node", "copies", "packed", "salt").mapInArrow(assign, VISIT)


TASK = ("dims", "shard", "sub", "chunk")


def _tasks(visits: DataFrame, s: Settings) -> DataFrame:
    """dims, shard, sub, chunk, chunks, index, query, place, node, copies, packed: every visit in each of its tasks.

    A shard has one sub unless it has more than shard_limit nodes, and one chunk of searches unless more than chunk_rows visit it.
    """
    node, search = F.col("place").bitwiseAND(NODE) > 0, F.col("place").bitwiseAND(SEARCH) > 0
    over = lambda n, limit: F.ceil(n / limit).cast("long")
    sizes = visits.groupBy("dims", "shard").agg(F.count("*").alias("v"), F.count_if(node).alias("i"))
    sizes = sizes.select(F.col("dims").alias("d"), F.col("shard").alias("s"), F.greatest(over(F.col("i"), s.shard_limit), F.lit(1).cast("long")).alias("subs"), over(F.col("v"), s.chunk_rows).alias("chunks"))
    each = visits.join(sizes, (F.col("dims") == F.col("d")) & (F.col("shard") == F.col("s")))
    each = each.withColumn("own_sub", F.pmod(F.xxhash64("node", F.lit(2)), F.col("subs"))).withColumn("own_chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    searches = F.transform(upto(F.col("subs")), lambda o: F.struct(o.alias("sub"), F.col("own_chunk").alias("chunk"), ((o == F.col("own_sub")) & node).alias("index"), search.alias("query")))
    others = F.transform(F.filter(upto(F.col("chunks")), lambda c: node & (c != F.col("own_chunk"))), lambda c: F.struct(F.col("own_sub").alias("sub"), c.alias("chunk"), F.lit(True).alias("index"), F.lit(False).alias("query")))
    return each.withColumn("task", F.explode(F.filter(F.concat(searches, others), lambda t: t.index | t.query))).select("dims", "shard", "task.sub", "task.chunk", "chunks", "task.index", "task.query", "place", "node", "copies", "packed")


def _build(table: pa.Table, s: Settings) -> pa.Table:
    """(node, its neighbours, and the shard's key) of one shard."""
    dims, shard, sub, chunks = (table.column(c)[0].as_py() for c in ("dims", "shard", "sub", "chunks"))
    vectors, node = _matrix(table.column("packed"), dims), table.column("node").to_numpy()
    n = len(node)
    near = node[graph_of(vectors, s.degree, s.far, s.pool, s.alpha)] if n > 1 else np.empty((1, 0), np.int64)
    key = [pa.array([x] * n, t) for x, t in ((dims, pa.int32()), (shard, pa.int64()), (sub, pa.int64()), (chunks, pa.int64()))]
    return pa.table([pa.array(node), pa.array(list(near), pa.list_(pa.int64())), *key], names=["n", "near", "dims", "shard", "sub", "chunks"])


def _search(table: pa.Table, lists: pa.Table, threshold: float, whole: bool) -> pa.Table:
    """kind 1: (node, copies of its partners); kind 0: links of a spanning forest."""
    index, query, place, node, copies = (table.column(c).to_numpy() for c in ("index", "query", "place", "node", "copies"))
    index, query = index.astype(bool), query.astype(bool)
    none = pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())], names=["kind", "u", "v"])
    if not index.any() or not query.any():
        return none
    every = _matrix(table.column("packed"), table.column("dims")[0].as_py())
    nodes, order = node[index], np.argsort(node[index])
    graph = np.arange(len(nodes))[:, None]
    if lists.num_rows and not whole:
        listed = lists.column("near").combine_chunks()
        lengths = np.diff(listed.offsets.to_numpy())
        begins = np.cumsum(lengths) - lengths
        at = order[np.searchsorted(nodes[order], lists.column("n").to_numpy())]
        graph = np.tile(graph, (1, max(1, int(lengths.max(initial=0)))))
        row, column = np.repeat(at, lengths), np.arange(lengths.sum()) - np.repeat(begins, lengths)
        wanted = listed.flatten().to_numpy()
        to = order[np.minimum(np.searchsorted(nodes[order], wanted), len(nodes) - 1)]
        inside = nodes[to] == wanted
        graph[row[inside], column[inside]] = to[inside]
        # Neighbours that are not in this shard leave gaps, which go to the end and are cut off.
        graph = np.take_along_axis(graph, np.argsort(graph == np.arange(len(nodes))[:, None], axis=1, kind="stable"), axis=1)
        graph = graph[:, : max(1, int((graph != np.arange(len(nodes))[:, None]).sum(axis=1).max()))]
    q, to = search_shard(every[query], every[index], graph, threshold, whole=whole)
    asked = node[query]
    # A vector is found in its nearest shard only, and not by itself.
    own = (place[index][to] >= HOME) & (asked[q] != nodes[to])
    q, to = q[own], to[own]
    partners = np.bincount(q, copies[index][to], len(asked))
    some = np.flatnonzero(partners)
    u, v = spanning(asked[q], nodes[to])
    kind = np.r_[np.ones(len(some), np.int32), np.zeros(len(u), np.int32)]
    return pa.table([pa.array(kind), pa.array(np.r_[asked[some], u]), pa.array(np.r_[partners[some].astype(np.int64), v])], names=["kind", "u", "v"])


def _graph_links(nodes: DataFrame, threshold: float, cells: Cells, reach: float, s: Settings) -> DataFrame:
    """The written result of all searches (kind, u, v)."""
    whole = reach >= 2
    visits = _first(nodes, cells.first, reach, s.overlap)
    if cells.second is not None:
        visits = _second(visits, cells.second, reach, s.overlap)
    visits = written(visits, "visits")
    tasks = _tasks(visits, s)
    built = tasks.where((F.col("index")) & (F.col("chunk") == F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")))).groupBy("dims", "shard", "sub").applyInArrow(lambda t: _build(t, s), "n long, near array<long>, dims int, shard long, sub long, chunks long")
    shards = F.collect_list(F.struct("dims", "shard", "sub", "chunks"))
    united = built.groupBy("n").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), shards.alias("ts")).select("n", "near", F.explode("ts").alias("t"))
    lists = united.select("n", "near", "t.dims", "t.shard", "t.sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t.chunks") - 1)).alias("chunk"))
    if whole:
        lists = lists.where(F.lit(False))
    found = tasks.groupBy(*TASK).cogroup(lists.groupBy(*TASK)).applyInArrow(lambda t, x: _search(t, x, threshold, whole), "kind int, u long, v long")
    found = written(found, "searched")
    discard(visits)
    return found


def _audit(nodes: DataFrame, partners: DataFrame, threshold: float, audited: int) -> float:
    """Of some nodes, lowest hashes first, the share of links that was found, or the mean share of a vector if that is lower; brute force gives all."""
    picked = [(r.node, r.dims, bytes(r.packed)) for r in nodes.orderBy(F.hash("node", F.lit(3)), "node").limit(audited).select("node", "dims", "packed").collect()]
    sent = nodes.sparkSession.sparkContext.broadcast(picked)  # `audited` vectors

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dims: dict[int, list] = {}
        for node, d, packed in sent.value:
            by_dims.setdefault(d, []).append((node, np.frombuffer(packed, np.float64)))
        total = {d: np.zeros(len(x), np.int64) for d, x in by_dims.items()}
        for batch in batches:
            node, dims, copies = (batch.column(k).to_numpy() for k in (0, 1, 2))
            for d in np.intersect1d(dims, list(by_dims)):
                own = dims == d
                ids = np.array([n for n, _ in by_dims[d]])
                near = _matrix(batch.column(3).filter(pa.array(own)), d) @ np.stack([v for _, v in by_dims[d]]).T >= threshold
                near &= node[own][:, None] != ids
                total[d] += (near * copies[own][:, None]).sum(axis=0)
        for d, x in by_dims.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.array([n for n, _ in x])), pa.array(total[d])], names=["a", "n"])

    true = nodes.select("node", "dims", "copies", "packed").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    met = true.join(partners, F.col("a") == F.col("w"), "left").where("n > 0").select("n", F.least("n", F.coalesce("partners", F.lit(0))).alias("found"))
    both = met.agg(F.sum("n").alias("n"), F.sum("found").alias("found"), F.avg(F.col("found") / F.col("n")).alias("mean")).first()
    return min(both.found / both.n, both.mean) if both.n else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """id, n_links, component_id, kept (the id is its component's) and recall (as audited) of every input row."""
    s = settings or Settings()
    every = written(unit_vectors(vectors, id_col, vector_col).withColumn("node", F.when(F.col("packed").isNotNull(), F.xxhash64("packed", "dims"))), "unit-vectors")
    copies = F.count_distinct("id") + F.count_if(F.col("id").isNull())
    nodes = written(every.where("node IS NOT NULL").groupBy("node", "dims", "packed").agg(F.min("id").alias("first"), copies.alias("copies")), "nodes")
    cells, reach = _train(nodes, s), s.reach
    while True:
        found = _graph_links(nodes, threshold, cells, reach, s)
        partners = found.where("kind = 1").groupBy("u").agg(F.sum("v").alias("partners")).withColumnRenamed("u", "w")
        recall = 1.0 if reach >= 2 else _audit(nodes, partners, threshold, s.audited)
        if recall >= s.aim:
            break
        discard(found)
        reach = 2.0 if reach >= 0.3 else reach * 2
    roots = written(connected_components(found.where("kind = 0").select("u", "v")), "components").withColumnRenamed("node", "r")
    of = nodes.join(partners, F.col("node") == F.col("w"), "left").join(roots, F.col("node") == F.col("r"), "left")
    of = of.select(F.col("node").alias("g"), "first", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = of.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "c")
    of = written(of.join(smallest, F.col("root") == F.col("c")).select("g", "n_links", "component_id"), "linked")
    for table in (nodes, found, roots):
        discard(table)
    out = every.drop("packed").join(of, F.col("node") == F.col("g"), "left")
    component = F.when(F.col("g").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.select("*", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall"))
