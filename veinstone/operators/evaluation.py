"""Evaluation: answers against cases, spread over repeated runs, retrieval against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_hit(answer: Column, keywords: Column) -> Column:
    """All keywords stand in the answer, each in one of its variants (separated by |); case doesn't count."""
    low = F.lower(answer)
    return F.forall(keywords, lambda k: F.exists(F.split(F.lower(k), r"\|"), lambda v: F.contains(low, v)))


def forbidden_hit(answer: Column, refused: Column, words: Column) -> Column:
    """An answer that isn't a refusal has a word that it must not have."""
    return ~refused & F.exists(words, lambda w: F.contains(F.lower(answer), F.lower(w)))


def share(condition: Column, among: Column | None = None, empty: float = 0.0) -> Column:
    """The share of rows with a condition, among those of another."""
    scope = F.lit(True) if among is None else among
    return F.round(F.coalesce(F.try_divide(F.count_if(scope & condition), F.count_if(scope)), F.lit(empty)), 4)


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Behaviour, coverage, citation resolution, hallucination and means of case results."""
    cited, dangling = F.sum("citation_count"), F.sum("dangling_citations")
    return results.groupBy(*by).agg(
        F.count("*").alias("total"),
        share(F.col("expected_answerable") != F.col("refused")).alias("behavior_correctness"),
        share(F.col("keyword_hit"), F.col("expected_answerable")).alias("answer_coverage"),
        F.round(F.coalesce(F.try_divide(cited, cited + dangling), F.lit(1.0)), 4).alias("citation_resolution_rate"),
        share(F.col("forbidden_hit")).alias("hallucination_rate"),
        F.round(F.avg("cost"), 4).alias("cost_per_question"),
        F.round(F.avg("tokens"), 4).alias("tokens_per_question"),
        F.round(F.avg("duration_s"), 4).alias("mean_latency_s"),
    )


def upper_median(value: Column) -> Column:
    """The value at place n // 2 of the sorted ones; the upper one of two in the middle."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def case_spread(results: DataFrame, case: str = "case_id", value: str = "llm_calls") -> DataFrame:
    """Least, middle and most of each case; the runs of a case are few by design."""
    return results.groupBy(case).agg(F.min(value).alias("low"), upper_median(F.col(value)).alias("mid"), F.max(value).alias("high"))


def cost_spread(results: DataFrame, case: str = "case_id") -> DataFrame:
    """One row: the middle of the cases' ratios of dearest to cheapest run; 1 without a case of two paid runs."""
    paid = results.where("cost > 0").groupBy(case).agg(F.max("cost").alias("high"), F.min("cost").alias("low"), F.count("*").alias("n")).where("n >= 2")
    ratios = paid.groupBy((F.col("high") / F.col("low")).alias("ratio")).agg(F.count("*").alias("n"))
    # The middle by counts of equal ratios, without gathering the cases in one list.
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ratio DESC)")
    return ratios.select(F.explode(F.array_repeat("ratio", F.col("n").cast("int"))).alias("ratio")).agg(F.round(F.coalesce(middle, F.lit(1.0)), 6).alias("cost_spread_ratio"))


def retrieval(found: DataFrame, *by: str) -> DataFrame:
    """hit@1, hit@5, hit@10, MRR and mean seconds of targets with their rank (null: not found)."""
    hit = lambda n: F.round(F.count_if(F.coalesce(F.col("rank") <= n, F.lit(False))) / F.count("*"), 6).alias(f"hit_{n}")
    return found.groupBy(*by).agg(F.count("*").alias("queries"), hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("seconds"), 6).alias("seconds"))
