"""Queries over vectors, full text and their fusion.

The tables stand for fragments: `embeddings` has the vectors (label plays the source), `documents` the texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dense, fusion, lexical
from ..operators.postings import Postings
from ..session import shared_dir, spread, stamp, table
from . import ingest
from .registry import Inline, Registry

registry = Registry()
query = registry.query

QUERY_IDS = (0, 7, 42)
K, POOL = 5, 20


def vectors_of(spark: SparkSession, sf: str, ids: tuple[int, ...]) -> list[tuple[int, list[float]]]:
    """A few query vectors by id; the driver holds no others."""
    rows = table(spark, sf, "embeddings").where(F.col("vec_id").isin(*ids)).select("vec_id", "embedding").collect()
    return sorted((r.vec_id, list(r.embedding)) for r in rows)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_PAIRS = f"SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, e.embedding, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id IN {QUERY_IDS}"


def _ranked(source: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM {source}) WHERE rank <= {k}"


@query("l2_normalize", f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 9) AS norm, round(v[1], 9) AS first, round(v[2], 9) AS second FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3 / sqrt(9 * {_DOT.format(a='embedding', b='embedding')})) AS v FROM embeddings)")
def l2_normalize(spark, sf):
    v = dense.normalized(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(dense.dot(F.col("v"), F.col("v")), 9).alias("norm"), F.round(F.get("v", F.lit(0)), 9).alias("first"), F.round(F.get("v", F.lit(1)), 9).alias("second"))


# The values of a whole text's characters, and their sums by place.
_VALUES = "list_transform(string_split({t}, ''), lambda c: (unicode(c) % 97) / 97.0::DOUBLE)"
_SUMS = "list_transform(range(0, 8), lambda d: coalesce(list_sum(list_slice({v}, d + 1, len({v}), 8)), 0))"


@query("hash_embed", f"SELECT doc_id, list_transform({_SUMS.format(v='v')}, lambda x: round(x, 9)) AS embedding FROM (SELECT doc_id, {_VALUES.format(t='text')} AS v FROM documents)")
def hash_embed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.transform(dense.hash_embedding(F.col("text")), lambda x: F.round(x, 9)).alias("embedding"))


BAD = Inline("id long, v array<float>", [(1, [0.6, 0.8]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0]), (7, [2.0, 0.0]), (8, None)])
_BAD_OUT = Inline("id long, fault string", [(2, "not unit"), (3, "not unit"), (4, "empty"), (5, "not finite"), (6, "dimension"), (7, "not unit"), (8, "empty")])


@query("vector_validate", f"SELECT CAST(id AS BIGINT) AS id, fault FROM {_BAD_OUT.values} UNION ALL SELECT vec_id + 100, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN abs(sqrt({_DOT.format(a='embedding', b='embedding')}) - 1) > 0.001 THEN 'not unit' END FROM embeddings WHERE len(embedding) <> 64 OR abs(sqrt({_DOT.format(a='embedding', b='embedding')}) - 1) > 0.001")
def vector_validate(spark, sf):
    bad = BAD.df(spark).select("id", dense.faults(F.col("v"), 2).alias("fault"))
    return bad.unionByName(table(spark, sf, "embeddings").select((F.col("vec_id") + 100).alias("id"), dense.faults(F.col("embedding"), 64).alias("fault"))).where("fault IS NOT NULL")


@query("dense_topk", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _PAIRS + ')', K)}) WHERE query_id = 0")
def dense_topk(spark, sf):
    return dense.top_k(table(spark, sf, "embeddings"), vectors_of(spark, sf, (0,)), K)


@query("dense_topk_multi", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _PAIRS + ')', K)})")
def dense_topk_multi(spark, sf):
    return dense.top_k(table(spark, sf, "embeddings"), vectors_of(spark, sf, QUERY_IDS), K)


@query("dense_topk_scoped", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _PAIRS + ' AND e.label IN (1, 3))', K)})")
def dense_topk_scoped(spark, sf):
    allowed = spark.createDataFrame([(1,), (3,)], "label int")
    return dense.top_k(table(spark, sf, "embeddings"), vectors_of(spark, sf, QUERY_IDS), K, allowed=allowed, scope_col="label")


def _pool(spark, sf):
    """The over-fetched pool of each query, without the query's own row (it would make every margin 0)."""
    queries = vectors_of(spark, sf, QUERY_IDS)
    found = dense.top_k(table(spark, sf, "embeddings"), queries, POOL + 1).where("id <> query_id").select("query_id", "id", "score")
    return dense.ranked(found, POOL).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id").withColumnRenamed("score", "relevance")


_MMR = f"""
WITH RECURSIVE pool AS (SELECT query_id, id, embedding, score AS rel FROM ({_ranked('(' + _PAIRS + ' AND e.vec_id <> q.vec_id)', POOL)})),
sims AS (SELECT a.query_id, a.id AS a, b.id AS b, round({_DOT.format(a='a.embedding', b='b.embedding')}, 6) AS sim FROM pool a JOIN pool b ON a.query_id = b.query_id),
sel AS (
  SELECT query_id, 1 AS step, [id] AS chosen, id, round({{l}} * rel, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({{l}} * rel, 6) DESC, id) AS n FROM pool) WHERE n = 1
  UNION ALL
  SELECT query_id, step + 1, list_append(chosen, nid), nid, margin FROM (
    SELECT s.query_id, s.step, s.chosen, p.id AS nid,
           round({{l}} * p.rel - {{m}} * (SELECT max(x.sim) FROM sims x WHERE x.query_id = p.query_id AND x.a = p.id AND list_contains(s.chosen, x.b)), 6) AS margin,
           row_number() OVER (PARTITION BY s.query_id ORDER BY round({{l}} * p.rel - {{m}} * (SELECT max(x.sim) FROM sims x WHERE x.query_id = p.query_id AND x.a = p.id AND list_contains(s.chosen, x.b)), 6) DESC, p.id) AS n
    FROM sel s JOIN pool p ON s.query_id = p.query_id AND NOT list_contains(s.chosen, p.id) WHERE s.step < {K}) WHERE n = 1)
SELECT query_id, id, score, CAST(step AS INT) AS rank FROM sel"""


@query("mmr_select", _MMR.format(l="0.5::DOUBLE", m="0.5::DOUBLE"))
def mmr_select(spark, sf):
    return dense.mmr(_pool(spark, sf), K, 0.5)


@query("mmr_relevance_only", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _PAIRS + ' AND e.vec_id <> q.vec_id)', K)})")
def mmr_relevance_only(spark, sf):
    """At lambda 1 the choice is the plain top k."""
    return dense.mmr(_pool(spark, sf), K, 1.0)


QUERIES = Inline("query_id long, query string", [(1, "there with ension"), (2, "the la de und"), (3, "License version"), (4, "zzzz"), (5, ""), (6, "heation nder ciónado")])
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(docs: str) -> str:
    """docs: a query that gives id and tok."""
    return f"""
WITH d AS ({docs}), s AS (SELECT count(*) AS n, avg(len(tok)) AS mean FROM d),
qt AS (SELECT DISTINCT query_id, unnest({_TOK.format('query')}) AS term FROM {QUERIES.values}),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(tok) AS len, unnest(tok) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT p.id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS part FROM p JOIN f USING (term), s)
SELECT query_id, id, round(sum(part), 6) AS score FROM w JOIN qt USING (term) GROUP BY query_id, id"""


_BODY = f"SELECT doc_id AS id, {_TOK.format('text')} AS tok FROM documents"


_built: dict[tuple, Postings] = {}


def index_of(spark: SparkSession, sf: str, name: str, tokens: Column) -> Postings:
    """The full-text index of a field of `documents`, kept in the shared folder for as long as the session lasts and the table is the same."""
    key = (spark.sparkContext.applicationId, name, stamp(spark, f"{sf}/documents.parquet"))
    if key not in _built:
        docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), tokens.alias("tokens"))
        _built[key] = Postings.built(docs, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}")
    return _built[key]


def body_index(spark: SparkSession, sf: str) -> Postings:
    return index_of(spark, sf, "body", text.tokens(F.col("text")))


def _asked(spark: SparkSession) -> DataFrame:
    return lexical.query_terms(QUERIES.df(spark), text.tokens(F.col("query")))


def _lexical(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return dense.ranked(body_index(spark, sf).best(_asked(spark), k), k)


@query("bm25_topk", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _bm25_sql(_BODY) + ')', 10)})")
def bm25_topk(spark, sf):
    return _lexical(spark, sf, 10)


@query("bm25_pruned", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _bm25_sql(_BODY) + ')', 3)})")
def bm25_pruned(spark, sf):
    """The three best, with proof that stripes left closed hold none of them, however small the index."""
    return dense.ranked(body_index(spark, sf).best(_asked(spark), 3, few=0), 3)


@query("index_postings", f"SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS total, CAST(max(tf) AS INT) AS most, CAST(min(len) AS INT) AS shortest, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT id, len(tok) AS len, term, count(*) AS tf FROM (SELECT id, tok, unnest(tok) AS term FROM ({_BODY})) GROUP BY ALL) GROUP BY term")
def index_postings(spark, sf):
    """What the blocks of each term hold together."""
    blocks = body_index(spark, sf).rows.where("term IS NOT NULL")
    ids = F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x))
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"), F.max("most").alias("most"), F.min("shortest").alias("shortest"), ids.alias("ids"))


@query("bm25_scoped", f"SELECT query_id, id, score, rank FROM ({_ranked('(' + _bm25_sql(_BODY + chr(32) + 'WHERE lang = ' + chr(39) + 'fr' + chr(39)) + ')', 10)})")
def bm25_scoped(spark, sf):
    french = table(spark, sf, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id"))
    return dense.ranked(body_index(spark, sf).scores(_asked(spark), french), 10)


_TITLE = f"SELECT doc_id AS id, {_TOK.format('string_split(text, chr(10))[1]')} AS tok FROM documents"


@query("bm25_fields", f"SELECT query_id, id, score, rank FROM ({_ranked('(SELECT query_id, id, round(sum(score), 6) AS score FROM (SELECT * FROM (' + _bm25_sql(_BODY) + ') UNION ALL SELECT * FROM (' + _bm25_sql(_TITLE) + ')) GROUP BY query_id, id)', 10)})")
def bm25_fields(spark, sf):
    """Body plus title, where the first line stands for the title; the CJK field gives the same terms here and so the same maximum."""
    title = index_of(spark, sf, "title", text.tokens(F.get(F.split("text", "\n"), F.lit(0))))
    return dense.ranked(lexical.combined([body_index(spark, sf).scores(_asked(spark))], title.scores(_asked(spark))), 10)


_ROUTES = "(SELECT label AS query_id, vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS rank FROM embeddings UNION ALL SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS INT) FROM embeddings WHERE vec_id % 3 <> 1)"


@query("rrf_fusion", f"SELECT query_id, id, score, rank FROM ({_ranked('(SELECT query_id, id, round(sum(1 / (60.0::DOUBLE + rank)), 8) AS score FROM ' + _ROUTES + ' GROUP BY query_id, id)', 100)})")
def rrf_fusion(spark, sf):
    """Of each label's vectors two rankings, by id and, of two thirds, by their first number."""
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).alias("score"))
    by_id = dense.ranked(rows.withColumn("score", -F.col("id")), 2**31 - 1)
    return fusion.reciprocal_rank([by_id, dense.ranked(rows.where("id % 3 <> 1"), 2**31 - 1)], top_n=100)


_DENSE_TEXT = f"""SELECT q.query_id, d.id, round({_DOT.format(a='q.v', b='d.v')} / (sqrt({_DOT.format(a='q.v', b='q.v')}) * sqrt({_DOT.format(a='d.v', b='d.v')})), 6) AS score
FROM (SELECT query_id, {_SUMS.format(v='x')} AS v FROM (SELECT query_id, {_VALUES.format(t='query')} AS x FROM {QUERIES.values} WHERE query <> '')) q,
(SELECT id, {_SUMS.format(v='x')} AS v FROM (SELECT doc_id AS id, {_VALUES.format(t='text')} AS x FROM documents)) d"""


def _dense_text(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The k nearest texts of each query; the vectors of what is asked at once go to the texts as a matrix."""
    asked = ingest.embedded(QUERIES.df(spark).where("query <> ''"), 8, ("query_id",), "query").collect()
    docs = ingest.embedded(spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text"), 8, ("id",))
    return dense.top_k(docs, sorted((r.query_id, list(r.embedding)) for r in asked), k, "id", "embedding")


_HYBRID = f"""
WITH d AS ({_ranked('(' + _DENSE_TEXT + ')', 3 * K)}), l AS ({_ranked('(' + _bm25_sql(_BODY) + ')', 3 * K)}),
f AS (SELECT query_id, id, round(sum(1 / (60.0::DOUBLE + rank)), 8) AS score FROM (SELECT query_id, id, rank FROM d WHERE query_id IN (SELECT query_id FROM l) UNION ALL SELECT query_id, id, rank FROM l) GROUP BY query_id, id)
SELECT query_id, id, score, rank FROM ({_ranked('f', K)}) UNION ALL SELECT query_id, id, score, rank FROM d WHERE rank <= {K} AND query_id NOT IN (SELECT query_id FROM l)"""


@query("hybrid_rrf", _HYBRID)
def hybrid_rrf(spark, sf):
    return fusion.hybrid(_dense_text(spark, sf, 3 * K), _lexical(spark, sf, 3 * K), K)


@query("rerank", f"""
WITH p AS (SELECT query_id, id FROM ({_ranked('(' + _bm25_sql(_BODY) + ')', 3 * K)})),
c AS (SELECT p.query_id, p.id, list_distinct({_TOK.format('q.query')}) AS asked, list_distinct({_TOK.format('d.text')}) AS has FROM p JOIN (SELECT * FROM {QUERIES.values}) q ON p.query_id = q.query_id JOIN documents d ON p.id = d.doc_id)
SELECT query_id, id, score, rank FROM ({_ranked('(SELECT query_id, id, round(len(list_intersect(asked, has)) / len(asked)::DOUBLE, 6) AS score FROM c)', K)})""")
def rerank(spark, sf):
    pool = _lexical(spark, sf, 3 * K).select("query_id", "id")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return fusion.rerank(pool.join(QUERIES.df(spark), "query_id").join(texts, "id"), K)


@query("papers_by_hits", f"SELECT source, CAST(count(*) AS BIGINT) AS hits FROM ({_ranked('(' + _bm25_sql(_BODY) + ')', 50)}) h JOIN documents d ON h.id = d.doc_id GROUP BY source ORDER BY hits DESC, source LIMIT 10")
def papers_by_hits(spark, sf):
    found = _lexical(spark, sf, 50).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return found.groupBy("source").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "source").limit(10)
