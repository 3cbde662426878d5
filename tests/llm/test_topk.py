import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.llm import topk as T


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, block int")


def brute(rows, k, query):
    made = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    out = set()
    for q, a in made:
        if query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in made if i != q)[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize(("n", "dims", "scale"), [(400, 8, 0.2), (300, 64, 0.1), (60, 2, 3000.0), (5, 3, 1.0)])
def test_against_brute_force(spark, n, dims, scale):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, dims)) * scale).astype(np.float32)
    x[n // 2 :: 3] = x[0]
    rows = [(int(i) * 10, v.tolist()) for i, v in enumerate(x)]
    out = T.top_k(table(spark, rows), F.col("id") % 100 == 0, k=10, block_rows=97, chunk_bytes=600).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out} == brute(rows, 10, lambda q: q % 100 == 0)


def test_index_stops_on_proof():
    rng = np.random.default_rng(0)
    v = rng.integers(-300, 300, (3000, 32)).astype(np.int64)
    v[7] = v[100] * 2
    index = T.ImpactIndex(v, T.ImpactIndex.ordered(v))
    for q in (100, 5, 2999):
        places, scores = index.search(q, v[q], 10)
        exact = v @ v[q]
        assert len(places) < 3000 and scores.tolist() == exact[places].tolist()
        exact[q] = -(10**15)
        assert set(np.lexsort((np.arange(3000), -exact))[:10].tolist()) <= set(places.tolist())
    assert set(index.search(1, np.zeros(32, np.int64), 3)[1].tolist()) == {0}


def test_hard_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (1, None), (2, []), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (8, [0.25, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    out = T.top_k(table(spark, rows), F.col("id") % 100 == 0, k=10).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in out} == {(0, 1, None), (0, 2, 8), (0, 3, 100), (100, 1, 0), (100, 2, 8), (100, 3, None)}
    assert T.top_k(table(spark, []), F.col("id") % 100 == 0).collect() == []


def test_repeated_ids(spark):
    """A row that repeats a query's id is a candidate like any other."""
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0])]
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score >> 20) for r in T.top_k(table(spark, rows), F.col("id") % 100 == 0).collect())
    assert out == sorted([(100, 1, 7, 1), (100, 2, 100, 0), (100, 3, 100, 0), *[(100, 1, 7, 1), (100, 2, 100, 1), (100, 3, 100, 0)] * 2])


def test_large_components(spark):
    """Components up to 2**40 and beyond: exact, and a score beyond a long is the nearest long."""
    rng = np.random.default_rng(3)
    values = [[float(x) for x in rng.integers(-(2**40), 2**40, 3)] for _ in range(30)] + [[1.5, -0.25, 0.001], [3e6, 0.0, 0.0], [1e300, 1.0, 0.0], [-1e308, 1.0, 1.0]] + [[float(x) for x in rng.normal(size=3)] for _ in range(30)]
    rows = [(k * 10, v) for k, v in enumerate(values)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = T.top_k(made, F.col("id") % 100 == 0, k=10, block_rows=20).collect()
    whole = [(i, [T._whole(x) for x in v]) for i, v in rows]
    want = set()
    for q, a in whole:
        if q % 100 == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), i) for i, b in whole if i != q)[:10]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out} == want
