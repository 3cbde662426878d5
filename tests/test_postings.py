"""The full-text index: blocks, bounds, deletions; held against BM25 over the documents themselves."""

import random

import pytest
from pyspark.sql import functions as F

from veinstone.operators import dense, lexical, postings

WORDS = [f"w{k}" for k in range(40)]


def made(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(k, [WORDS[min(39, int(rng.expovariate(0.12)))] for _ in range(rng.choice([0, 3, 12, 80]))]) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ["w1", None, "w1"])], "id long, tokens array<string>")


def asked(spark, *queries):
    return spark.createDataFrame([(k, t) for k, q in enumerate(queries) for t in q.split()], "query_id long, term string")


def brute(docs, terms, k):
    return sorted(dense.ranked(lexical.bm25(docs.withColumn("length", F.coalesce(F.size("tokens"), F.lit(0))).withColumn("length", F.greatest("length", F.lit(0))), terms.distinct()), k).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(postings, "STRIPE", 8)
    monkeypatch.setattr(postings, "HELD", 300)
    monkeypatch.setattr(postings, "FIRST", 2)


def test_best_is_exact_and_opens_few_stripes(spark, tmp_path, small):
    docs = made(spark, 400).repartition(3)
    postings.write(docs, str(tmp_path / "segment=0"), 4, stripe=8)
    index = postings.Postings(spark, str(tmp_path), ["0"], buckets=4)
    terms = asked(spark, "w0 w1", "w30", "w3 w20 w35", "none", "w2 w2")
    assert sorted(dense.ranked(index.scores(terms), 5).collect()) == brute(docs, terms, 5)
    assert sorted(dense.ranked(index.best(terms, 5, few=0), 5).collect()) == brute(docs, terms, 5)
    plan = index.plan(terms, 5)
    every, opened = plan.bounds.count(), plan.first.count() + plan.rest.count()
    assert opened < every


def test_only_buckets_of_the_terms_are_read(spark, tmp_path, small):
    postings.write(made(spark, 50), str(tmp_path / "segment=0"), 16)
    index = postings.Postings(spark, str(tmp_path), ["0"], buckets=16)
    blocks = index.blocks(asked(spark, "w1"))
    assert {r.bucket for r in blocks.select("bucket").distinct().collect()} < set(range(16))
    filters = blocks._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1]
    assert "bucket" in filters.split("]")[0]


def test_blocks_are_small_and_hold_everything(spark, tmp_path):
    docs = spark.range(1000).select("id", F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id").cast("string"))).alias("tokens"))
    postings.write(docs, str(tmp_path / "segment=0"), 4)
    rows = postings.Postings(spark, str(tmp_path), ["0"], buckets=4).rows
    assert rows.agg(F.max(F.size("ids"))).first()[0] <= postings.STRIPE
    assert rows.where("term = 'a'").agg(F.sum("n")).first()[0] == 1000 and rows.where("term LIKE 'b%'").count() == 1000


def test_scope_and_deletions_change_the_statistics(spark, tmp_path):
    docs = made(spark, 120)
    postings.write(docs.where("id % 2 = 0"), str(tmp_path / "segment=0"))
    postings.write(docs.where("id % 2 = 1 OR id % 10 = 0"), str(tmp_path / "segment=1"))
    dead = spark.createDataFrame([("0", k) for k in range(0, 122, 10)] + [("1", 7)], "segment string, id long")
    index = postings.Postings(spark, str(tmp_path), ["0", "1"], dead=dead)
    terms = asked(spark, "w0 w5", "w9")
    alive = docs.where("id <> 7")
    assert sorted(dense.ranked(index.best(terms, 7), 7).collect()) == brute(alive, terms, 7)
    some = docs.where("id < 60").select("id")
    assert sorted(dense.ranked(index.scores(terms, some), 7).collect()) == brute(alive.where("id < 60"), terms, 7)
    assert index.scores(terms, some.where("false")).collect() == []


def test_empty_and_null(spark, tmp_path):
    docs = made(spark, 0).where("false")
    postings.write(docs, str(tmp_path / "segment=0"))
    index = postings.Postings(spark, str(tmp_path), ["0"])
    assert index.best(asked(spark, "w1"), 3).collect() == [] and index.totals[0] == 0
    assert postings.Postings(spark, str(tmp_path), []).scores(asked(spark, "w1")).collect() == []
    text = spark.createDataFrame([("x", ["a"]), ("y", ["b", "a"])], "id string, tokens array<string>")
    named = postings.Postings.built(text, str(tmp_path / "named"))
    assert {r.id for r in named.best(asked(spark, "a b"), 1).collect()} == {"x", "y"}
