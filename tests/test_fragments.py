"""Chunk invariants against their SQL on documents without fragments, repeated ones and those without a key."""

import duckdb
import pytest

from veinstone.plans import catalog

TEXTS = [
    (1, "Rain fell. It stopped."),
    (2, ""),
    (3, None),
    (4, "1. Introduction"),
    (5, "References\n[1] A, 2019."),
    (6, " \n\t​"),
    (7, "One sentence of many. " * 400),
    (7, "One sentence of many. " * 400),
    (7, "The same id, another text."),
    (None, "No id."),
    (4, "1. Introduction"),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_every_document_has_its_row(spark, folder):
    df = catalog.queries()["chunk_invariants"](spark, folder)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = duck.execute(catalog.oracle_sql()["chunk_invariants"])
    assert df.columns == [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))
