"""Queries through stored indexes: segments after several builds, keyed vectors, cells of vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells, dense, lexical, postings
from ..operators.vector_store import InvalidVectors, VectorStore
from ..session import shared_dir, spread, stamp, table
from ..sources.segments import Segments
from .registry import Registry
from .retrieval_queries import K, QUERIES, QUERY_IDS, _PAIRS, _TOK, _bm25_sql, _ranked, vectors_of

registry = Registry()
query = registry.query

_built: dict[tuple, object] = {}
DOCS = "source_key string, doc_id long, text string"

#: The state after the three builds: a third of the documents comes later, every fifth is changed, every seventh is removed.
_STATE = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed version ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


def replayed(spark: SparkSession, sf: str) -> Segments:
    """The documents, in three builds: most of them, then the others with new texts of some, then without some."""
    key = (spark.sparkContext.applicationId, "segments", stamp(spark, f"{sf}/documents.parquet"))
    if key not in _built:
        store = Segments(spark, f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}", ("docs",))
        docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").cast("string").alias("source_key"), "doc_id", "text")
        late, changed, gone = F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0
        newer = F.when(changed, F.concat(F.lit("changed version "), F.col("text"))).otherwise(F.col("text"))
        for new, ended in ((docs.where(~late), None), (docs.where(late | changed).withColumn("text", newer), docs.where(~late & changed)), (docs.where("false"), docs.where(gone))):
            change = store.change()
            rows = change.add("docs", new)
            postings.write(rows.select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("tokens")), store.path("words", change.version))
            if ended is not None:
                change.end(ended.select("source_key"))
            change.commit()
        _built[key] = store
    return _built[key]


@query("segments_replay", f"SELECT doc_id, md5(text) AS digest, length(text) AS n_chars FROM ({_STATE})")
def segments_replay(spark, sf):
    """What is live after the builds; the second and third touched only their own rows."""
    return replayed(spark, sf).read("docs", DOCS).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query("segments_search", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _bm25_sql(f'SELECT doc_id AS id, {_TOK.format('text')} AS tok FROM ({_STATE})') + ')', 10)})")
def segments_search(spark, sf):
    """BM25 over the segments: deleted and replaced documents are neither found nor counted."""
    store = replayed(spark, sf)
    at, dead = store.snapshot(), store.dead()
    index = postings.Postings(spark, f"{store.root}/words", at.names, dead=dead.select(F.col("in_segment").alias("segment"), F.col("key").cast("long").alias("id")))
    return dense.ranked(index.best(lexical.query_terms(QUERIES.df(spark), text.tokens(F.col("query"))), 10), 10)


@query("vector_upsert", "SELECT vec_id AS id, CAST(label AS VARCHAR) AS source_key, round(CASE WHEN label = 1 THEN -1 ELSE 1 END * CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 9) AS first FROM embeddings WHERE label <> 2 UNION ALL SELECT vec_id + 1000000000, 'new', round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 9) FROM embeddings WHERE label = 0")
def vector_upsert(spark, sf):
    """All vectors by id; then those of one label turned around and copies of another's added; one label removed; and a batch that is refused."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("label").cast("string").alias("source_key"), dense.normalized(F.col("embedding")).alias("embedding"))
    store = VectorStore(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", 64)
    store.upsert(rows)
    turned = rows.where("label = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    copied = rows.where("label = 0").withColumn("id", F.col("id") + 1_000_000_000).withColumn("source_key", F.lit("new"))
    store.upsert(turned.unionByName(copied))
    store.remove_source("2")
    try:
        store.upsert(rows.withColumn("embedding", F.transform("embedding", lambda x: 2 * x)))
    except InvalidVectors:
        pass
    else:
        raise AssertionError("vectors of length 2 were taken")
    return store.read().select("id", "source_key", F.round(F.get("embedding", F.lit(0)), 9).alias("first"))


def cells_of(spark: SparkSession, sf: str) -> cells.Cells:
    key = (spark.sparkContext.applicationId, "cells", stamp(spark, f"{sf}/embeddings.parquet"))
    if key not in _built:
        root = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
        cells.build(table(spark, sf, "embeddings"), root)
        _built[key] = root
    return cells.Cells(spark, _built[key], 64)


@query("dense_cells", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _PAIRS + ')', K)})")
def dense_cells(spark, sf):
    """Exact top k from a stored index, by cells that can hold one of the best."""
    return cells_of(spark, sf).top_k(vectors_of(spark, sf, QUERY_IDS), K)
