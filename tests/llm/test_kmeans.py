import hashlib

import numpy as np
import pytest

from veinstone.llm import kmeans as K

SCHEMA = "vec_id long, embedding array<float>, cluster int, c int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, o, d in found if o == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found)


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 2), (1, 3), (20, 4)])
def test_against_brute_force(spark, k, rounds, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 50)
    rng = np.random.default_rng(k)
    centers = rng.normal(size=(6, 5))
    rows = [(int(j * 7 + 1), (centers[rng.integers(6)] + 0.3 * rng.normal(size=5)).astype(np.float32).tolist()) for j in range(300)]
    rows += rows[:9] + [(1000 + j, rows[0][1]) for j in range(80)]
    assert got(K.cluster(table(spark, rows).repartition(5), k=k, rounds=rounds, dims=5)) == brute(rows, k, rounds, 5)


def test_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, size=(4000, 2))  # a small grid: very many equal distances
    rows = rng.integers(-3, 4, size=(9, 2))
    cluster, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
    before = None
    for _ in range(6):
        at = K.Centroids(rows, before)
        cluster, upper, lower, _ = at.assign(x, cluster, upper, lower)
        assert (cluster == ((x[:, None] - rows) ** 2).sum(axis=2).argmin(axis=1)).all()
        before, rows = rows, np.array([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else rows[j] for j in range(len(rows))])


def test_balls_and_bounds_save_distances():
    rng = np.random.default_rng(5)
    centers = rng.integers(-5000, 5000, size=(40, 8))
    x = centers[rng.integers(0, 40, 5000)] + rng.integers(-300, 300, size=(5000, 8))
    first = K.Centroids(x[:40])
    none = np.zeros(len(x))
    cluster, upper, lower, taken = first.assign(x, np.full(len(x), -1), none, none)
    assert taken == x.shape[0] * 40
    moved = np.array([x[cluster == j].sum(axis=0) // (cluster == j).sum() for j in range(40)])
    second = K.Centroids(moved, first.rows)
    again, _, _, taken = second.assign(x, cluster, upper, lower)
    assert (again == K.squared(x, moved).argmin(axis=1)).all()
    assert taken < x.shape[0] * 20


def test_large_values_stay_exact():
    x = np.array([[2**27 - 1, -(2**27) + 1], [0, 3]])
    assert K.squared(x, x)[0].tolist() == [0, (2**27 - 1) ** 2 + (2**27 + 2) ** 2]


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(None, [1.0, 2.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (7, [5.0, 1.0]), (8, [131071.0, -2.0])]
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [-inf, 1.0]), (6, [1.0, 2.0, 3.0]), (9, [131072.0, 1.0])]
    assert got(K.cluster(table(spark, good + bad), k=8, rounds=4, dims=2)) == brute(good, 8, 4, 2)
    assert got(K.cluster(table(spark, bad), dims=2)) == got(K.cluster(table(spark, []), dims=2)) == []
