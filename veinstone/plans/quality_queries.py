"""Queries over metadata and evaluation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import evaluation, metadata
from ..session import table
from .registry import Inline, Registry, Templates

registry = Registry()
query = registry.query

FIELDS = ["title", "year", "venue", "doi", "citation_count", "is_oa", "quality_tier", "retracted"]
MATCHES = Templates(
    "source long, provider string, confidence string, score double, title string, year int, venue string, doi string, citation_count int, is_oa boolean, quality_tier int, retracted boolean",
    [
        (1, "crossref", "doi", 1.0, "Title C @id@", 2020, None, "10.1/a@id@", 5, None, None, None),
        (1, "semantic_scholar", "title", 0.9, "Title S @id@", 2019, "Venue S", None, 9, None, None, None),
        (1, "openalex", "doi", 1.0, "Title O", None, "Venue O @source@", None, 7, True, 2, None),
        (2, "crossref", "title", 0.5, "Wrong", 1999, "W", None, 1, None, None, None),
        (2, "openalex", "title", 0.8, "Right @id@", 2001, None, None, None, False, 0, None),
        (3, "retraction", "doi", 1.0, None, None, None, None, None, None, None, True),
        (3, "zeta", "none", 0.0, "Z", 1990, None, None, None, None, None, False),
        (3, "alpha", "none", 0.0, "A", 1991, None, None, None, None, None, None),
        (4, "crossref", "title", 0.1, "Low", None, None, None, None, None, None, None),
    ],
)
BASE = Templates("source long, title string, year int, venue string, doi string, citation_count int, is_oa boolean, quality_tier int, retracted boolean", [(1, "Own title @id@", None, None, None, None, None, None, False), (2, None, None, None, None, None, None, None, True), (3, None, 2005, None, None, None, None, None, None), (4, None, None, None, None, None, None, None, None), (5, "Alone", 1, None, None, None, None, None, None)])


def _pick(f: str) -> str:
    if f == "retracted":
        return "CASE WHEN bool_or(retracted) THEN true END AS retracted"
    order = list(metadata.PRIORITY[f])
    return f"arg_min({f}, lpad(CAST(list_position(['doi', 'title', 'none'], confidence) AS VARCHAR), 2, '0') || lpad(CAST(coalesce(list_position({order}, provider), {len(order) + 1}) AS VARCHAR), 2, '0') || provider) FILTER ({f} IS NOT NULL) AS {f}"


@query("metadata_merge", f"""
WITH m AS (SELECT source_key, {', '.join(map(_pick, FIELDS))} FROM (SELECT CAST(source AS VARCHAR) AS source_key, * EXCLUDE (source) FROM {MATCHES.values}) WHERE confidence <> 'title' OR score >= 0.8 GROUP BY source_key)
SELECT b.source_key, {', '.join(f'coalesce(b.{f}, false) OR coalesce(m.{f}, false) AS {f}' if f == 'retracted' else f'coalesce(b.{f}, m.{f}) AS {f}' for f in FIELDS)} FROM (SELECT CAST(source AS VARCHAR) AS source_key, * EXCLUDE (source) FROM {BASE.values}) b LEFT JOIN m ON b.source_key = m.source_key""")
def metadata_merge(spark, sf):
    keyed = lambda rows: rows.withColumn("source_key", F.col("source").cast("string")).drop("source")
    return metadata.fill(keyed(BASE.df(spark, sf)), metadata.merge(keyed(MATCHES.df(spark, sf)), FIELDS), FIELDS)


RETRACTED = Inline("doi string", [("https://doi.org/10.5/7",), ("DOI:10.5/12",), (" 10.5/X1 ",), (None,)])


@query("retraction_flag", "SELECT p_partkey, CAST(p_partkey % 50 IN (7, 12) AS BOOLEAN) AS retracted FROM part")
def retraction_flag(spark, sf):
    sources = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("http://dx.doi.org/10.5/"), (F.col("p_partkey") % 50).cast("string")).alias("doi"))
    return metadata.flag_retracted(sources, RETRACTED.df(spark)).select("p_partkey", "retracted")


@query("title_match", r"""
WITH t AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\p{L}\p{N}]+'), lambda x: length(x) > 2 AND NOT list_contains(""" + str(list(metadata.text.TITLE_STOP)) + r""", x))) AS a FROM documents),
b AS (SELECT item_id AS candidate, list_distinct(list_filter(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\p{L}\p{N}]+'), lambda x: length(x) > 2 AND NOT list_contains(""" + str(list(metadata.text.TITLE_STOP)) + r""", x))) AS b FROM benchmark),
s AS (SELECT id, candidate, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM t, b WHERE len(a) > 0 AND len(b) > 0)
SELECT id, candidate, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, candidate) AS n FROM s WHERE similarity >= 0.8) WHERE n = 1""")
def title_match(spark, sf):
    first = F.get(F.split("text", "\n"), F.lit(0)).alias("title")
    return metadata.best_titles(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), first), table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), first))


def _payloads(rows: list[tuple[int, object]]) -> Templates:
    return Templates("id long, payload string", [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in rows])


CROSSREF = _payloads([
    (1, {"title": ["", "<i>Deep</i> Nets @id@"], "author": [{"given": "Ada", "family": "Lovelace"}, {"family": "Turing"}, {"name": "A Group"}], "issued": {"date-parts": [[2019, 3]]}, "DOI": "10.1/ABC@id@", "container-title": ["J. Tests"], "is-referenced-by-count": 12, "abstract": "<jats:p>About @id@.</jats:p>"}),
    (2, {"title": [], "author": [], "DOI": None}),
    (3, "not json"),
])


_WORKS = Templates("id long, title string, authors string, year int, doi string, venue string, abstract string, citation_count int", [(1, "Deep Nets @id@", "Ada Lovelace|Turing|A Group", 2019, "10.1/abc@id@", "J. Tests", "About @id@.", 12), (2, None, "", None, None, None, None, None), (3, None, None, None, None, None, None, None)])


@query("map_crossref", f"SELECT * FROM {_WORKS.values}")
def map_crossref(spark, sf):
    made = CROSSREF.df(spark, sf).select("id", metadata.crossref(F.col("payload")).alias("p")).select("id", "p.*")
    return made.withColumn("authors", F.array_join("authors", "|"))


S2 = _payloads([(1, {"title": "T @id@", "authors": [{"name": "A B@id@"}, {"name": None}], "year": 2021, "externalIds": {"DOI": "10.2/X@id@"}, "citationCount": 3}), (2, {"title": None, "externalIds": None}), (3, {})])


@query("map_s2", """SELECT id, payload ->> '$.title' AS title, CASE WHEN json_exists(payload, '$.authors') THEN array_to_string(list_filter(json_extract_string(payload, '$.authors[*].name'), lambda x: x IS NOT NULL), '|') END AS authors,
CAST(payload ->> '$.year' AS INT) AS year, lower(payload ->> '$.externalIds.DOI') AS doi, CAST(payload ->> '$.citationCount' AS INT) AS citation_count FROM """ + S2.values)
def map_s2(spark, sf):
    made = S2.df(spark, sf).select("id", metadata.semantic_scholar(F.col("payload")).alias("p")).select("id", "p.*")
    return made.withColumn("authors", F.array_join("authors", "|"))


_OPEN = _payloads([
    (1, {"title": " Work @id@ ", "display_name": "Other", "authorships": [{"author": {"display_name": "A. One"}}, {"author": None}, {}, {"author": {"display_name": "B @source@"}}], "publication_year": 2021, "doi": "https://doi.org/10.3/ABC@id@", "primary_location": {"source": {"display_name": "J. @id@", "type": "journal", "is_in_doaj": True}}, "cited_by_count": 7, "open_access": {"is_oa": True, "oa_url": "https://x.org/@id@"}}),
    (2, {"title": None, "display_name": "Shown @id@", "authorships": [], "publication_year": "1999", "doi": None, "primary_location": None, "open_access": None}),
    (3, {"title": "", "authorships": None, "publication_year": 99999, "primary_location": {"source": None}, "open_access": {"is_oa": False, "oa_url": None}}),
    (4, "no json @id@"),
])
_OPEN_OUT = Templates("id long, title string, authors string, year int, doi string, venue string, citation_count int, is_oa boolean, oa_url string, quality_tier int", [(1, "Work @id@", "A. One|B @source@", 2021, "10.3/abc@id@", "J. @id@", 7, True, "https://x.org/@id@", 3), (2, "Shown @id@", None, 1999, None, None, None, None, None, None), (3, None, None, None, None, None, None, False, None, None), (4, None, None, None, None, None, None, None, None, None)])


@query("map_openalex", f"SELECT * FROM {_OPEN_OUT.values}")
def map_openalex(spark, sf):
    made = _OPEN.df(spark, sf).select("id", metadata.openalex(F.col("payload")).alias("p")).select("id", "p.*")
    return made.withColumn("authors", F.array_join("authors", "|"))


_UNPAYWALL = _payloads([(1, {"is_oa": True, "best_oa_location": {"url_for_pdf": "https://y.org/@id@.pdf", "url": "u"}}), (2, {"is_oa": True, "best_oa_location": {"url_for_pdf": None, "url": "https://y.org/@id@"}}), (3, {"is_oa": False, "best_oa_location": None}), (4, {})])
_UNPAYWALL_OUT = Templates("id long, is_oa boolean, oa_url string", [(1, True, "https://y.org/@id@.pdf"), (2, True, "https://y.org/@id@"), (3, False, None), (4, None, None)])


@query("map_unpaywall", f"SELECT * FROM {_UNPAYWALL_OUT.values}")
def map_unpaywall(spark, sf):
    return _UNPAYWALL.df(spark, sf).select("id", metadata.unpaywall(F.col("payload")).alias("p")).select("id", "p.*")


_loc = lambda **s: {"primary_location": {"source": s}}
OPENALEX = _payloads([(1, _loc(type="journal", is_in_doaj=True)), (2, _loc(type="journal", is_in_doaj=False)), (3, _loc(type="repository")), (4, _loc(type="conference")), (5, _loc(type=None)), (6, {"primary_location": {"source": None}}), (7, {"primary_location": None}), (8, _loc(type="book series")), (9, _loc(type="Proceedings")), (10, {})])


@query("quality_tier", """SELECT id, CAST(CASE WHEN s IS NULL OR s = 'null' THEN NULL WHEN k IS NULL OR k = 'repository' THEN 0 WHEN k IN ('conference', 'proceedings') THEN 1 WHEN k = 'journal' AND d = 'true' THEN 3 WHEN k = 'journal' THEN 2 END AS INT) AS tier
FROM (SELECT id, CAST(payload -> '$.primary_location.source' AS VARCHAR) AS s, lower(payload ->> '$.primary_location.source.type') AS k, payload ->> '$.primary_location.source.is_in_doaj' AS d FROM """ + OPENALEX.values + ")")
def quality_tier(spark, sf):
    return OPENALEX.df(spark, sf).select("id", metadata.openalex_tier(F.col("payload")).alias("tier"))


CASES = Templates("id long, answer string, refused boolean, expected array<string>, forbidden array<string>", [(1, "@text@ The BERT model wins", False, ["bert|roberta", "model"], ["gpt"]), (2, "GPT is better @text@", False, ["bert"], ["gpt"]), (3, "GPT", True, [], ["gpt"]), (4, "", True, ["x"], [])])


@query("keyword_hit", f"SELECT id, len(list_filter(expected, lambda k: len(list_filter(string_split(lower(k), '|'), lambda v: contains(lower(answer), v))) = 0)) = 0 AS hit, NOT refused AND len(list_filter(forbidden, lambda w: contains(lower(answer), lower(w)))) > 0 AS forbidden_hit FROM {CASES.values}")
def keyword_hit(spark, sf):
    return CASES.df(spark, sf).select("id", evaluation.keyword_hit(F.col("answer"), F.col("expected")).alias("hit"), evaluation.forbidden_hit(F.col("answer"), F.col("refused"), F.col("forbidden")).alias("forbidden_hit"))


_RESULTS = """SELECT user_id AS case_id, event_type AS strategy, user_id % 4 <> 0 AS expected_answerable, event_type = 'error' AS refused, event_id % 3 <> 0 AS keyword_hit, event_type <> 'error' AND event_id % 29 = 0 AS forbidden_hit,
CAST(event_id % 5 AS BIGINT) AS citation_count, CAST(event_id % 2 AS BIGINT) AS dangling_citations, value AS cost, CAST(event_id % 1000 AS BIGINT) AS tokens, CAST(event_id % 40 AS BIGINT) AS llm_calls, value / 10 AS duration_s FROM events"""


def _results(spark, sf):
    """The event log as the results of repeated runs: users are cases, event types strategies."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        u.alias("case_id"), F.col("event_type").alias("strategy"), (u % 4 != 0).alias("expected_answerable"), (F.col("event_type") == "error").alias("refused"), (e % 3 != 0).alias("keyword_hit"),
        ((F.col("event_type") != "error") & (e % 29 == 0)).alias("forbidden_hit"), (e % 5).alias("citation_count"), (e % 2).alias("dangling_citations"), F.col("value").alias("cost"), (e % 1000).alias("tokens"), (e % 40).alias("llm_calls"), (F.col("value") / 10).alias("duration_s"),
    )


_SUMMARY = """count(*) AS total, round(avg(CAST(expected_answerable <> refused AS INT)), 4) AS behavior_correctness, round(coalesce(avg(CAST(keyword_hit AS INT)) FILTER (expected_answerable), 0), 4) AS answer_coverage,
round(coalesce(sum(citation_count) / nullif(sum(citation_count + dangling_citations), 0)::DOUBLE, 1), 4) AS citation_resolution_rate, round(avg(CAST(forbidden_hit AS INT)), 4) AS hallucination_rate,
round(avg(cost), 4) AS cost_per_question, round(avg(tokens), 4) AS tokens_per_question, round(avg(duration_s), 4) AS mean_latency_s"""


@query("eval_summary", f"SELECT {_SUMMARY} FROM ({_RESULTS})")
def eval_summary(spark, sf):
    return evaluation.summary(_results(spark, sf))


@query("ablation_grid", f"SELECT strategy, expected_answerable, {_SUMMARY} FROM ({_RESULTS}) GROUP BY strategy, expected_answerable")
def ablation_grid(spark, sf):
    return evaluation.summary(_results(spark, sf), "strategy", "expected_answerable")


@query("case_spread", f"SELECT case_id, min(llm_calls) AS low, list_sort(list(llm_calls))[CAST(count(*) // 2 + 1 AS INT)] AS mid, max(llm_calls) AS high FROM ({_RESULTS}) GROUP BY case_id")
def case_spread(spark, sf):
    return evaluation.case_spread(_results(spark, sf))


@query("cost_spread", f"SELECT round(coalesce(list_sort(list(r))[CAST(count(*) // 2 + 1 AS INT)], 1), 6) AS cost_spread_ratio FROM (SELECT max(cost) / min(cost) AS r FROM ({_RESULTS}) WHERE cost > 0 GROUP BY case_id HAVING count(*) >= 2)")
def cost_spread(spark, sf):
    return evaluation.cost_spread(_results(spark, sf))


_FOUND = "SELECT event_type AS strategy, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 15 + 1 AS INT) END AS rank, value AS seconds FROM events"


@query("retrieval_metrics", f"SELECT strategy, count(*) AS queries, {', '.join(f'round(avg(CASE WHEN rank <= {n} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_{n}' for n in (1, 5, 10))}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(seconds), 6) AS seconds FROM ({_FOUND}) GROUP BY strategy")
def retrieval_metrics(spark, sf):
    e = F.col("event_id")
    found = table(spark, sf, "events").select(F.col("event_type").alias("strategy"), F.when(e % 4 != 0, (e % 15 + 1).cast("int")).alias("rank"), F.col("value").alias("seconds"))
    return evaluation.retrieval(found, "strategy")
