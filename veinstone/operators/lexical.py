"""Full-text retrieval: postings for the terms asked for, BM25 over fields, and their combination.

Postings are never built for a whole corpus to answer a query: only tokens that a query asks for go on
to be counted. Whether the terms are broadcast is left to Spark's check of their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
DIGITS = 6


def query_terms(queries: DataFrame, terms: Column) -> DataFrame:
    """query_id, term: distinct terms of each query (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(terms)).alias("term"))


def documents(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """id, tokens, length."""
    return docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")).withColumn("length", F.size("tokens"))


def among(tokens: Column, asked: list[str]) -> Column:
    """The tokens that are asked for, repeated ones too."""
    return F.filter(tokens, lambda t: t.isin(*asked))


def bm25(docs: DataFrame, terms: DataFrame, k1: float = K1, b: float = B, few: bool = False) -> DataFrame:
    """query_id, id, score of the documents (id, tokens, length) that share a term with a query.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)), over all documents given, however many match.
    With `few` terms, they and their statistics are sent around: no task gets all hits of a frequent term.
    """
    sent = F.broadcast if few else lambda rows: rows
    stats = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    wanted = terms.select("term").distinct()
    # Tokens meet the terms asked for before anything is shuffled, if those are few enough to be sent around.
    # Outer, as otherwise a filter on the token array would be pushed down, and tokens be made twice; a null term meets nothing.
    hits = docs.select("id", "length", F.explode_outer("tokens").alias("term")).join(sent(wanted), "term", "left_semi")
    postings = hits.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
    idf = df.select(F.col("term").alias("t"), "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = postings.join(sent(idf), F.col("term") == F.col("t"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return weighted.select("id", "term", part.alias("part")).join(sent(terms), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def combined(body: list[DataFrame], title: DataFrame | None = None, boost: float = 1.0) -> DataFrame:
    """query_id, id, score: the best body field plus `boost` times the title; a title alone is a hit."""
    fields = body[0]
    for other in body[1:]:
        fields = fields.unionByName(other)
    best = fields.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    if title is None:
        return best
    both = best.withColumn("w", F.lit(1.0)).unionByName(title.withColumn("w", F.lit(boost)))
    return both.groupBy("query_id", "id").agg(F.round(F.sum(F.col("score") * F.col("w")), DIGITS).alias("score"))
