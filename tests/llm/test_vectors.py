import numpy as np
import pytest

from veinstone.llm import vectors as V


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, node long")


def brute(ids, x, threshold):
    x = x.astype(np.float64)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = (x @ x.T >= threshold) & (ids[:, None] != ids)
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], label.max() + 1).min(axis=1))
        if np.array_equal(new, label):
            return near.sum(axis=1), label
        label = new


def clustered(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, n // 12), dims))
    return (centers[rng.integers(0, len(centers), n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


@pytest.mark.parametrize("settings", [V.Settings(), V.Settings(shard_rows=60, shard_limit=90, overlap=3), V.Settings(shard_rows=100, shard_limit=20, max_centroids=2)])
def test_against_brute_force(spark, settings):
    x = clustered(600, 16, 1, 0.25)
    x[300:340] = x[0]
    x[340:440] = x[1] + 0.02 * np.random.default_rng(2).normal(size=(100, 16))
    ids = np.arange(600) * 3 + 1
    out = {r.vec_id: r for r in V.near_duplicates(table(spark, [(int(i), v.tolist(), "x", 1) for i, v in zip(ids, x)]), settings=settings).collect()}
    links, label = brute(ids, x, 0.9)
    got = np.array([out[i].n_links for i in ids])
    assert (got <= links).all() and got.sum() >= 0.95 * links.sum()
    assert np.mean([out[i].component_id == c for i, c in zip(ids, label)]) > 0.95
    assert all(out[i].kept == (out[i].component_id == i) for i in ids.tolist())


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1e-30, 0.0]), (8, [1e30, 0.0]), (8, [1e30, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    out = V.near_duplicates(table(spark, [(*r, "x", 0) for r in rows])).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    # A null id is a vector too, which belongs to the component of 7.
    assert by[7] == (2, 7, True) and by[8] == (2, 7, False) and by[None] == (2, 7, False)
    assert all(by[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 9, 10))


def test_empty(spark):
    assert V.near_duplicates(table(spark, [])).collect() == []


def test_large_near_group_loses_no_link(spark):
    rng = np.random.default_rng(5)
    center = rng.normal(size=64)
    x = (center / np.linalg.norm(center) + 0.0325 * rng.normal(size=(4000, 64))).astype(np.float32)
    x = np.concatenate([x, rng.normal(size=(2000, 64)).astype(np.float32)])
    out = {r.vec_id: r for r in V.near_duplicates(table(spark, [(k, v.tolist(), "x", 1) for k, v in enumerate(x)]), settings=V.Settings(shard_rows=500)).collect()}
    links, label = brute(np.arange(len(x)), x, 0.9)
    got = np.array([out[k].n_links for k in range(len(x))])
    assert links.sum() > 5_000_000 and (got <= links).all() and got.sum() >= 0.97 * links.sum()
    assert np.mean([out[k].component_id == c for k, c in enumerate(label)]) > 0.99


def test_divided_cells_and_exact_way(spark):
    x = clustered(900, 16, 4, 0.25)
    rows = [(k, v.tolist(), "x", 1) for k, v in enumerate(x)]
    links, label = brute(np.arange(900), x, 0.9)
    deep = {r.vec_id: r for r in V.near_duplicates(table(spark, rows), settings=V.Settings(shard_rows=40, max_centroids=5)).collect()}
    got = np.array([deep[k].n_links for k in range(900)])
    assert (got <= links).all() and got.sum() >= 0.95 * links.sum()
    # An aim above 1 is never met, so the search ends with every shard as one block.
    exact = {r.vec_id: r for r in V.near_duplicates(table(spark, rows), settings=V.Settings(shard_rows=40, max_centroids=5, shard_limit=30, chunk_rows=25, reach=0.4, aim=0.999999)).collect()}
    assert [exact[k].n_links for k in range(900)] == links.tolist() or next(iter(exact.values())).recall >= 0.999999
