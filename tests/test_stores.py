"""Keyed tables and cells of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.operators import cells, dense
from veinstone.operators.vector_store import InvalidVectors, VectorStore

SCHEMA = "id long, source_key string, embedding array<double>"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), 2, buckets=4)
    assert store.read().collect() == [] and store.remove_source("a") == 0
    first = store.upsert(batch(spark, *[(k, "ab"[k % 2], [1.0, 0.0]) for k in range(40)]))
    second = store.upsert(batch(spark, (3, "c", [0.6, 0.8]), (99, "c", [0.0, 1.0])))
    assert 0 < sum(v == second for v in store.folders().values()) <= 2 and first in store.folders().values()
    out = {r.id: r for r in store.read().collect()}
    assert len(out) == 41 and out[3].embedding == [0.6, 0.8] and out[99].source_key == "c"
    assert store.remove_source("a") == 20 and store.remove_source("a") == 0 and store.read().count() == 21


@pytest.mark.parametrize("rows", [[(1, "a", [2.0, 0.0])], [(1, "a", [])], [(1, "a", None)], [(1, "a", [1.0])], [(1, "a", [float("nan"), 0.0])], [(None, "a", [1.0, 0.0])], [(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])]])
def test_one_bad_row_refuses_the_batch(spark, tmp_path, rows):
    store = VectorStore(spark, str(tmp_path), 2)
    version = store.upsert(batch(spark, (1, "a", [1.0, 0.0])))
    with pytest.raises(InvalidVectors):
        store.upsert(batch(spark, (2, "a", [0.0, 1.0]), *rows))
    assert store.current() == version and [r.id for r in store.read().collect()] == [1]


def test_a_crash_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, str(tmp_path), 2)
    store.upsert(batch(spark, (1, "a", [1.0, 0.0])))
    monkeypatch.setattr(VectorStore, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.upsert(batch(spark, (1, "b", [0.0, 1.0])))
    assert [r.source_key for r in store.read().collect()] == ["a"]


def test_cells_are_exact_and_skipped(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 4
    x = centres[rng.integers(0, 20, 600)] + 0.2 * rng.normal(size=(600, 8))
    x[50:70] = x[50]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 8), (1003, [None] * 8)], "vec_id long, embedding array<double>")
    cells.build(rows, str(tmp_path), 150)
    index = cells.Cells(spark, str(tmp_path), 8)
    queries = [(k, x[k].tolist()) for k in (0, 55, 300)] + [(9, [0.0] * 8)]
    got = index.top_k(queries, 7).collect()
    assert sorted(got) == sorted(dense.top_k(rows.where("vec_id < 1000"), queries, 7).collect())
    assert all(index.opened[k] < len(index.cells) / 2 for k in (0, 55, 300)) and index.opened[9] == len(index.cells)
    assert index.read(index.cells[:1]).select(F.input_file_name().alias("f")).where("f NOT LIKE '%cell=%'").count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        cells.Cells(spark, str(tmp_path), 9)
    gone = next((tmp_path / "vectors").glob("cell=*/*.parquet"))
    gone.unlink()
    with pytest.raises(ValueError, match="rows of"):
        cells.Cells(spark, str(tmp_path), 8)


def test_no_vectors(spark, tmp_path):
    cells.build(spark.createDataFrame([], "vec_id long, embedding array<double>"), str(tmp_path), 3)
    assert cells.Cells(spark, str(tmp_path)).top_k([(1, [1.0])], 3).collect() == []
