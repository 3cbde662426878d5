"""Connected components of a link table, by alternating stars, and union-find on one partition's links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


class Forest:
    """Union-find over the numbers 0 to n - 1, many links at a time; the root of a set is its smallest number."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)

    def all_roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links node to root, at most one per node, that join what the links a-b join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.link(at[: len(a)], at[len(a) :])
    roots = forest.all_roots()
    own = roots != np.arange(len(nodes))
    return nodes[own], nodes[roots[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 1_000_000:
            a, b = spanning(a, b)
    a, b = spanning(a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def contract(links: DataFrame) -> DataFrame:
    """(u, v) of each partition replaced by fewer links that join the same nodes; u is above v."""
    return links.mapInArrow(_contract, "u long, v long")


def connected_components(links: DataFrame) -> DataFrame:
    """node long, root long of every node that has a link: root is the smallest node of its component.

    `links` has two long columns; nulls don't link. Alternating large and small stars: in each half
    round every node's neighbours hang themselves on the smallest of them; rounds are logarithmic in
    the longest path. A node with very many neighbours is an ordinary skewed join key, which adaptive
    execution splits. Each round is written to the shared folder, so no lineage grows.
    """
    a, b = links.columns
    # Written before anything else in Python follows, so that a task needs one Python worker.
    low, high = F.least(F.col(a), F.col(b)).cast("long"), F.greatest(F.col(a), F.col(b)).cast("long")
    edges = written(links.where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND `{a}` <> `{b}`").select(high.alias("u"), low.alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        small = written(contract(small.where("u <> v")).distinct(), "links")
        discard(large)
        discard(edges)
        edges, before, state = small, state, _state(small)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h
