"""Rank fusion, hybrid routes and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .dense import ranked

DIGITS = 8


def reciprocal_rank(routes: list[DataFrame], rrf_k: int = 60, top_n: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the sum of 1 / (rrf_k + rank) over routes (query_id, id, rank), ties by id."""
    if rrf_k < 1:
        raise ValueError("rrf_k must be 1 or more")
    every = routes[0].select("query_id", "id", "rank")
    for r in routes[1:]:
        every = every.unionByName(r.select("query_id", "id", "rank"))
    # Added up in order of rank, so that the sum doesn't depend on the shuffle.
    parts = F.transform(F.sort_array(F.collect_list("rank")), lambda r: 1 / (rrf_k + r))
    fused = every.groupBy("query_id", "id").agg(F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), DIGITS).alias("score"))
    return ranked(fused, top_n if top_n is not None else 2**31 - 1)


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """The fusion of two ranked routes; a query without a lexical hit keeps its dense ranks and scores."""
    found = lexical.select("query_id").distinct()
    alone = dense.join(found, "query_id", "left_anti").where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
    fused = reciprocal_rank([dense.join(found, "query_id", "left_semi"), lexical], rrf_k, k)
    return fused.select("query_id", "id", "score", "rank").unionByName(alone)


def overlap_score(query: Column, text: Column) -> Column:
    """The offline scorer: the share of the query's distinct tokens that the text has."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(asked, F.array_distinct(tokens(text)))) / F.size(asked), 6))


def rerank(candidates: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """query_id, id, score, rank of candidates (query_id, query, id, text) by a scorer, ties by id."""
    made = overlap_score(F.col("query"), F.col("text")) if score is None else score
    return ranked(candidates.select("query_id", "id", made.alias("score")), k)
