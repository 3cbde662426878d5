import numpy as np
import pytest

from veinstone.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)


def brute(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float64)) + 100_000
    y = x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / len(x))
    return x.astype(np.int64), y, e[::-1], v[:, ::-1]


def by_row(out):
    rows = {}
    for r in out.collect():
        rows.setdefault(r.vec_id, {})[r.component] = r
    return rows


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    made = (rng.normal(size=(700, 12)) * (2.0 ** -np.arange(12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + rng.normal(size=12)).astype(np.float32)
    rows = by_row(W.whiten(table(spark, [(int(k), v.tolist()) for k, v in enumerate(made)]).repartition(7), components=5))
    x, y, e, v = brute(made)
    n, sums = len(x), x.sum(axis=0)
    assert len(rows) == n and all(sorted(r) == [1, 2, 3, 4, 5] for r in rows.values())
    assert all(rows[k][1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums)) for k in range(0, n, 50))
    got = np.array([[rows[k][c].whitened for c in range(1, 6)] for k in range(n)])
    expected = y @ v[:, :5] / np.sqrt(e[:5])
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - signs * expected).max() < 1e-9
    assert [rows[0][c].explained for c in range(1, 6)] == pytest.approx(e[:5] / e.sum(), rel=1e-10)
    assert 0 <= rows[0][1].identity_error < 1e-12
    assert rows[3][1].n == n


def test_small_deviations_keep_their_digits():
    rng = np.random.default_rng(2)
    values = 10.0 ** -np.arange(0, 14, 2)
    left, right = (np.linalg.qr(rng.normal(size=s))[0] for s in ((40, 7), (7, 7)))
    got, v = W.rotated(np.linalg.qr(left * values, mode="r"))
    assert got == pytest.approx(values, rel=1e-9)
    assert np.abs(v.T @ v - np.eye(7)).max() < 1e-14
    got, v = W.rotated(left * values @ right.T)
    assert got[:6] == pytest.approx(values[:6], rel=1e-4)


@pytest.mark.parametrize("d", [1, 2, 3, 8])
def test_rotations_of_any_width(d):
    a = np.random.default_rng(d).normal(size=(max(d - 1, 1), d))
    values, v = W.rotated(a)
    assert values == pytest.approx(np.r_[np.linalg.svd(a)[1], np.zeros(d)][:d], abs=1e-12)
    off = (a @ v).T @ (a @ v)
    assert np.abs(off - np.diag(np.diag(off))).max() < 1e-12


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(None, [1.0, 2.0, 0.5]), (7, [0.0, 1.0, 0.5]), (7, [0.0, 1.0, 0.5]), (8, [3.0, -2.0, 0.5])]
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [1.0, 2.0]), (9, [3e38, 1.0, 1.0])]
    out = W.whiten(table(spark, good + bad)).collect()
    assert sorted((str(r.vec_id), r.component) for r in out) == sorted((str(i), c) for i, _ in good for c in (1, 2, 3))
    assert all((r.whitened is None) == (r.component == 3) for r in out)  # the third dimension is constant
    assert out[0].identity_error < 1e-12 and out[0].n == 4
    assert W.whiten(table(spark, [])).collect() == W.whiten(table(spark, bad[:5])).collect() == []


def test_constant_vectors_and_large_values(spark):
    same = W.whiten(table(spark, [(k, [1.0, 2.0]) for k in range(3)])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    large = by_row(W.whiten(table(spark, [(1, [float(2**45), 1.0]), (2, [float(-(2**45)), 2.0]), (3, [0.0, 4.0])])))
    assert large[1][1].deviation is None  # beyond a long
    assert large[3][1].deviation == 0 + (3 * 4 - 7) ** 2 * 1024**2
    assert large[1][1].whitened == pytest.approx(-large[2][1].whitened)
