"""An index that is scanned for one run: the answers of a stored one, and no tables of terms, postings or vectors."""

import os

from veinstone.operators import chunking, lexical
from veinstone.plans import ask, ingest, pipeline_queries
from veinstone.plans.settings import Retrieval, Settings

TEXTS = ["Rain fell on the hills. Rivers rose.\nMore rain came.", "Licences\nA license version is named here, version two.", "雨停了。天晴了！", "", "Nothing of that. Rivers again."]


def test_scanned_finds_what_a_stored_index_finds(spark, tmp_path):
    docs = [(str(k), f"h{k}", [(1, t)]) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(docs, "source_key string, document_hash string, pages array<struct<page_number: int, text: string>>").coalesce(1)
    sources = docs.selectExpr("source_key", "document_hash AS content_hash", "'d' AS rel_path", "split(pages[0].text, '\\n')[0] AS title", "CAST(NULL AS STRING) AS doi")
    settings = Settings(retrieval=Retrieval(strategy="hybrid_rrf"))
    questions = spark.createDataFrame([(1, "rivers and rain"), (2, "license version"), (3, "")], "query_id long, query string")
    found = []
    for kind, name in ((ask.Index, "stored"), (ask.Scanned, "scanned")):
        store = ingest.stored(f"file://{tmp_path}/{name}", chunking.fragments(docs), sources, settings, scanned=name == "scanned")
        found.append(sorted(map(tuple, ask.search(kind(spark, store, settings), questions).collect())))
    assert found[0] == found[1] and found[0]


def test_a_single_run_stores_no_full_text_index(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, t, "web") for k, t in enumerate(TEXTS)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pipeline_queries, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    pipeline_queries._index(spark, str(tmp_path))
    tables = {name for at, names, _ in os.walk(f"{tmp_path}/shared") for name in names if not name.startswith((".", "_"))}
    assert {"fragments", "sources"} <= tables
    assert not tables & {"terms", "vectors", "words", "english"}


def test_a_single_run_reads_fragments_before_its_plan(spark, tmp_path, monkeypatch):
    """What is made of the fragments is held: the plan of the answers, which uses it several times, reads none of them."""
    spark.createDataFrame([(k, t, "web") for k, t in enumerate(TEXTS)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pipeline_queries, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    answers = pipeline_queries.ask_deterministic(spark, str(tmp_path))
    assert answers.count() == 3
    assert not [f for f in answers.inputFiles() if "/fragments/" in f or "/sources/" in f]


def test_terms_asked_for_are_those_of_all_terms(spark):
    texts = [*TEXTS, "Abilities, ability. Ponies pony; a version's versions, versioned: VERSIONS", "雨停了 rain 雨 rains1 raining"]
    fragments = spark.createDataFrame([(f"f{k}", "s", t) for k, t in enumerate(texts)], "fragment_id string, source_key string, text string").coalesce(1)
    words, stems = ["rain", "version", "雨停"], ["rain", "version", "poni", "abil", "river"]
    want = {r.fragment_id: ([t for t in r.tokens if t in words], r.length, [t for t in r.stems if t in stems], r.stem_length) for r in ingest.terms(fragments).collect()}
    found = {r.fragment_id: (r.tokens, r.length, r.stems, r.stem_length) for r in ingest.terms_among(fragments, words, stems).collect()}
    assert found == want and len(found) == len(texts)
    none = ingest.terms_among(fragments, [], []).collect()
    assert {r.fragment_id: r.length for r in none} == {k: v[1] for k, v in want.items()} and not any(r.tokens or r.stems for r in none)


def test_hits_of_a_frequent_term_are_not_dealt_by_it(spark):
    docs = spark.range(300).selectExpr("CAST(id AS STRING) AS id", "IF(id % 50 = 0, array('rain', 'rain', 'hill'), array('rain')) AS tokens", "CAST(3 AS INT) AS length")
    terms = spark.createDataFrame([(1, "rain"), (1, "hill"), (2, "hill"), (2, "none")], "query_id long, term string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = lexical.bm25(docs, terms, few=True)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        assert sorted(few.collect()) == sorted(lexical.bm25(docs, terms).collect()) and few.count() == 306
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
