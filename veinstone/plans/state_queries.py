"""Queries over incremental state, usage logs, evidence and agent control.

`documents` stands for files, `events` for a usage log, `conversations` for sessions, `labels` for judged evidence.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import evidence, state
from ..session import table
from .registry import Inline, Registry, Templates

registry = Registry()
query = registry.query


@query("last_write_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_write_wins(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return state.last_write_wins(log, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


_DISK = "SELECT CAST(doc_id AS VARCHAR) AS rel_path, CAST(n_chars % 3 AS VARCHAR) AS hash FROM documents"
_MANIFEST = "SELECT CAST(event_id AS VARCHAR) AS rel_path, CAST(user_id % 3 AS VARCHAR) AS hash, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events"


def _manifests(spark, sf):
    """Documents as the files on disk, events as the entries of an older manifest."""
    disk = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), (F.col("n_chars") % 3).cast("string").alias("hash"))
    old = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("rel_path"), (F.col("user_id") % 3).cast("string").alias("hash"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return disk, old


@query("manifest_diff", f"SELECT coalesce(d.rel_path, m.rel_path) AS rel_path, CASE WHEN m.rel_path IS NULL THEN 'added' WHEN d.rel_path IS NULL THEN 'removed' WHEN d.hash = m.hash AND m.status = 'ok' THEN 'skipped' WHEN m.status = 'failed' THEN 'retried' ELSE 'updated' END AS action FROM ({_DISK}) d FULL JOIN ({_MANIFEST}) m ON d.rel_path = m.rel_path")
def manifest_diff(spark, sf):
    return state.manifest_diff(*_manifests(spark, sf))


@query("shared_key_guard", "SELECT a.doc_id FROM (SELECT doc_id, sha256(text) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE sha256(b.text) = a.k AND b.doc_id <> a.doc_id)")
def shared_key_guard(spark, sf):
    """Of the labelled documents those whose content no other document has."""
    m = table(spark, sf, "documents").select(F.col("doc_id").alias("rel_path"), F.sha2("text", 256).alias("source_key"))
    stale = m.join(table(spark, sf, "labels").select(F.col("doc_id").alias("rel_path")), "rel_path", "left_semi")
    return state.purgeable(stale, m).select(F.col("rel_path").alias("doc_id"))


@query("evidence_upsert", "SELECT doc_id, quality, 'new' AS batch FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, quality, 'old' FROM labels WHERE toxic <> 1")
def evidence_upsert(spark, sf):
    old = table(spark, sf, "labels").select("doc_id", "quality", F.lit("old").alias("batch"))
    new = table(spark, sf, "labels").where("toxic = 1").select("doc_id", "quality", F.lit("new").alias("batch"))
    return state.upsert(old, new, "doc_id")


@query("novel_fragments", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def novel_fragments(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("index_status", "SELECT source, CAST(sum(CASE WHEN doc_id % 11 <> 0 THEN n ELSE 0 END) AS BIGINT) AS fragments, CAST(sum(CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed, count(*) AS files FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY source")
def index_status(spark, sf):
    ok = F.col("doc_id") % 11 != 0
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(F.when(ok, F.size(F.split("text", "\n"))).otherwise(0)).alias("fragments"), F.count_if(~ok).alias("failed"), F.count("*").alias("files"))


_USAGE = """SELECT user_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(event_id % 17 AS BIGINT) AS completion_tokens, CAST(event_id % 5 AS BIGINT) AS cached_tokens, CAST(1 AS BIGINT) AS llm_calls, CAST(event_type = 'view' AS BIGINT) AS cache_hits, CAST(event_type = 'error' AS BIGINT) AS parse_failures, CAST(0 AS BIGINT) AS dangling_citations, CAST(0 AS BIGINT) AS metadata_incomplete, CAST(event_id % 100 AS DOUBLE) AS estimated_cost, event_type <> 'signup' AS cost_known, CASE WHEN event_id % 2 = 0 THEN 'USD' ELSE 'CNY' END AS cost_currency FROM events"""


def _usage(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "user_id", e.alias("seq"), F.floor("value").cast("long").alias("prompt_tokens"), (e % 17).alias("completion_tokens"), (e % 5).alias("cached_tokens"), F.lit(1).cast("long").alias("llm_calls"),
        (F.col("event_type") == "view").cast("long").alias("cache_hits"), (F.col("event_type") == "error").cast("long").alias("parse_failures"), F.lit(0).cast("long").alias("dangling_citations"), F.lit(0).cast("long").alias("metadata_incomplete"),
        (e % 100).cast("double").alias("estimated_cost"), (F.col("event_type") != "signup").alias("cost_known"), F.when(e % 2 == 0, "USD").otherwise("CNY").alias("cost_currency"),
    )


@query("usage_rollup", f"SELECT user_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in state.COUNTERS)}, sum(estimated_cost) AS estimated_cost, bool_and(cost_known) AS cost_known, arg_min(cost_currency, (CASE WHEN cost_known THEN 0 ELSE 1 END) * 1000000000000 + seq) AS cost_currency FROM ({_USAGE}) GROUP BY user_id")
def usage_rollup(spark, sf):
    return state.usage_total(_usage(spark, sf), "user_id")


@query("usage_cost", f"SELECT seq, cached_tokens / 1e6::DOUBLE * 0.25::DOUBLE + (prompt_tokens - cached_tokens) / 1e6::DOUBLE * 2.0::DOUBLE + completion_tokens / 1e6::DOUBLE * 8.0::DOUBLE AS cost, cached_tokens / 1e6::DOUBLE * 2.0::DOUBLE + (prompt_tokens - cached_tokens) / 1e6::DOUBLE * 2.0::DOUBLE + completion_tokens / 1e6::DOUBLE * 8.0::DOUBLE AS cost_without_cache_price FROM ({_USAGE})")
def usage_cost(spark, sf):
    c, u, o = F.col("cached_tokens"), F.col("prompt_tokens") - F.col("cached_tokens"), F.col("completion_tokens")
    return _usage(spark, sf).select("seq", state.cost(c, u, o, 2.0, 0.25, 8.0).alias("cost"), state.cost(c, u, o, 2.0, None, 8.0).alias("cost_without_cache_price"))


@query("token_delta", f"SELECT seq, cumulative - lag(cumulative, 1, 0) OVER (PARTITION BY user_id ORDER BY seq) AS delta FROM (SELECT *, CAST(sum(prompt_tokens) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS cumulative FROM ({_USAGE}))")
def token_delta(spark, sf):
    readings = _usage(spark, sf).withColumn("cumulative", F.sum("prompt_tokens").over(Window.partitionBy("user_id").orderBy("seq")))
    return state.deltas(readings, "cumulative", "user_id", "seq").select("seq", "delta")


@query("budget_check", f"SELECT user_id, CASE WHEN t > 5000 THEN 'tokens' WHEN NOT known THEN NULL WHEN c > 2000 + 1e-9 THEN 'cost' END AS exceeded FROM (SELECT user_id, sum(prompt_tokens + completion_tokens) AS t, sum(estimated_cost) AS c, bool_and(cost_known) AS known FROM ({_USAGE}) GROUP BY user_id)")
def budget_check(spark, sf):
    return evidence.budget(state.usage_total(_usage(spark, sf), "user_id"), max_tokens=5000, max_cost=2000.0).select("user_id", "exceeded")


@query("no_gain_streak", "SELECT event_id, CAST(sum(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, block ORDER BY event_id) AS BIGINT) AS streak FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS block FROM events)")
def no_gain_streak(spark, sf):
    return state.streak(table(spark, sf, "events"), F.col("event_type") == "purchase", "user_id", "event_id").select("event_id", "streak")


@query("duplicate_groups", "SELECT key, array_to_string(list_sort(list(doc_id)), ',') AS doc_ids, count(*) AS n FROM (SELECT doc_id, substr(sha256(text), 1, 16) AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", identity.digest(F.col("text")).alias("key"))
    groups = keyed.groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.count("*").alias("n")).where("n > 1")
    return groups.select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("doc_ids"), "n")


@query("year_filter_keep_null", "SELECT o_orderkey, y AS year FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS y FROM orders) WHERE y IS NULL OR y BETWEEN 1993 AND 1995")
def year_filter_keep_null(spark, sf):
    year = F.when(F.col("o_orderkey") % 10 != 0, F.year("o_orderdate"))
    return evidence.in_years(table(spark, sf, "orders").select("o_orderkey", year.alias("year")), 1993, 1995)


@query("session_search", "SELECT conv_id, CAST(min(turn) AS BIGINT) AS first_turn, count(*) AS hits FROM conversations WHERE contains(lower(text), 'the') GROUP BY conv_id")
def session_search(spark, sf):
    found = table(spark, sf, "conversations").where(F.contains(F.lower("text"), F.lit("the")))
    return found.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("hits"))


_JUDGED = "SELECT d.doc_id, d.source, CAST(d.n_chars % 11 AS INT) AS relevance, 'ev-' || substr(sha256(d.source || ':' || d.doc_id), 1, 8) AS key FROM documents d"


def _judged(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") % 11).cast("int").alias("relevance"), identity.evidence_key(F.col("source"), F.col("doc_id").cast("string")).alias("key"))


@query("screen_topk", f"SELECT source, key, relevance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY relevance DESC, key) AS INT) AS rank FROM ({_JUDGED}) WHERE relevance >= 5) WHERE rank <= 10")
def screen_topk(spark, sf):
    return evidence.screened(_judged(spark, sf), 10, by="source").select("source", "key", "relevance", "rank")


@query("evidence_budget", f"SELECT source, doc_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) AS INT) AS rank FROM ({_JUDGED})) WHERE rank <= 12")
def evidence_budget(spark, sf):
    return evidence.budgeted(_judged(spark, sf), 12, by="source", seq="doc_id").select("source", "doc_id", "rank")


@query("build_context", f"SELECT source, string_agg(key || ' (' || source || '): ' || relevance, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, key) AS rank FROM ({_JUDGED}) WHERE relevance >= 5) WHERE rank <= 10 GROUP BY source")
def build_context(spark, sf):
    entry = F.concat("key", F.lit(" ("), "source", F.lit("): "), F.col("relevance").cast("string"))
    return evidence.context(evidence.screened(_judged(spark, sf), 10, by="source"), entry, by="source")


@query("rank_to_relevance", f"SELECT source, key, CAST(greatest(5, round_even(10.0 * (n - rank + 1) / n, 0)) AS INT) AS relevance FROM (SELECT source, key, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, key) AS rank, count(*) OVER (PARTITION BY source) AS n FROM ({_JUDGED}))")
def rank_to_relevance(spark, sf):
    w = Window.partitionBy("source")
    ranked = _judged(spark, sf).select("source", "key", F.row_number().over(w.orderBy(F.desc("relevance"), "key")).alias("rank"), F.count("*").over(w).alias("n"))
    return ranked.select("source", "key", evidence.rank_relevance(F.col("rank"), F.col("n"), 5).alias("relevance"))


@query("evidence_citation", f"SELECT j.key, '(' || coalesce(s.s_name, 'unknown') || ' page ' || j.relevance || ')' AS citation FROM ({_JUDGED}) j LEFT JOIN supplier s ON j.doc_id % 20 = s.s_suppkey")
def evidence_citation(spark, sf):
    sources = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_key"), F.col("s_name").alias("stem"))
    rows = _judged(spark, sf).withColumn("source_key", F.col("doc_id") % 20).withColumn("label", F.concat(F.lit("page "), F.col("relevance").cast("string")))
    return evidence.cited(rows, sources).select("key", "citation")


ANSWERS = Templates("answer_id long, raw string", [(1, "A@id@ (ev-aaaaaaaa, ev-bbbbbbbb). B [ev-cccccccc] ev-dddddddd ."), (2, "Only @id@ (ev-dddddddd) gone  (ev-eeeeeeee)."), (3, "none @id@"), (4, "INSUFFICIENT_EVIDENCE (ev-aaaaaaaa)"), (5, "(kept text @id@) and ev-aaaaaaaa twice (ev-aaaaaaaa)")])
EVIDENCE = Inline("key string, inline string, reference string", [("ev-aaaaaaaa", "smith2020rag page 3", "smith2020rag"), ("ev-bbbbbbbb", "li2021graph", "li2021graph"), ("ev-cccccccc", "unknown", "unknown")])


@query("dangling_citations", f"SELECT answer_id, count(e.key) AS valid, count(*) FILTER (k IS NOT NULL AND e.key IS NULL) AS dangling FROM (SELECT answer_id, unnest(CASE WHEN len(ks) = 0 THEN [NULL] ELSE ks END) AS k FROM (SELECT answer_id, list_distinct(regexp_extract_all(raw, '\\bev-[0-9a-f]{{8}}\\b')) AS ks FROM {ANSWERS.values})) LEFT JOIN (SELECT key FROM (VALUES ('ev-aaaaaaaa'), ('ev-bbbbbbbb'), ('ev-cccccccc')) AS v(key)) e ON k = e.key GROUP BY answer_id")
def dangling_citations(spark, sf):
    return evidence.citation_counts(ANSWERS.df(spark, sf), EVIDENCE.df(spark))


BOUND = Templates(
    "answer_id long, text string, keys string, refused boolean, uncited boolean",
    [
        (1, "A@id@ (smith2020rag page 3, li2021graph). B (unknown).", "ev-aaaaaaaa,ev-bbbbbbbb,ev-cccccccc", False, False),
        (2, "Only @id@ gone.", "", True, True),
        (3, "none @id@", "", True, True),
        (4, "INSUFFICIENT_EVIDENCE (ev-aaaaaaaa)", "", True, False),
        (5, "(kept text @id@) and (smith2020rag page 3) twice (smith2020rag page 3)", "ev-aaaaaaaa", False, False),
    ],
)


@query("bind_citations", f"SELECT answer_id, text, keys, refused, uncited FROM {BOUND.values}")
def bind_citations(spark, sf):
    return evidence.bound(ANSWERS.df(spark, sf), EVIDENCE.df(spark))


STATES = Templates("id long, notes array<string>, answered boolean, refused boolean, uncited boolean", [(1, ["synthesis_failed", "timeout"], True, False, True), (2, ["timeout"], True, True, True), (3, ["budget_exceeded", "finish:done"], True, False, False), (4, ["finish:done"], True, False, False), (5, ["finish:no"], True, True, False), (6, [], True, True, False), (7, [], False, None, None), (8, ["finish:x"], False, None, None), (9, ["other"], True, False, False)])


@query("session_status", f"SELECT id, CASE WHEN list_contains(notes, 'synthesis_failed') THEN 'FAIL' WHEN answered AND uncited THEN 'UNCITED' WHEN len(list_intersect(notes, ['timeout', 'budget_exceeded', 'max_steps_exceeded', 'no_new_evidence'])) > 0 THEN 'TRUNCATED' WHEN len(list_filter(notes, lambda n: starts_with(n, 'finish:'))) > 0 THEN CASE WHEN answered AND NOT refused THEN 'SUCCESS' ELSE 'UNSURE' END WHEN answered AND refused THEN 'REFUSED' ELSE 'UNSURE' END AS status FROM {STATES.values}")
def session_status(spark, sf):
    return STATES.df(spark, sf).select("id", evidence.status(F.col("notes"), F.col("answered"), F.col("refused"), F.col("uncited"), fallback="UNSURE").alias("status"))


@query("compact_history", "SELECT conv_id, turn, CASE WHEN total > 100 AND k >= 2 AND k < greatest(2, n - 4) AND role = 'assistant' AND length(text) > 200 THEN role || ' (compacted): ' || substr(string_split(text, chr(10))[1], 1, 200) ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n, sum(floor(length(text) / 4.0)) OVER (PARTITION BY conv_id) AS total FROM conversations)")
def compact_history(spark, sf):
    return evidence.compacted(table(spark, sf, "conversations"), limit=100, role="assistant").select("conv_id", "turn", "text")


@query("derived_flags", "SELECT doc_id, source IS NOT NULL AND lang IS NOT NULL AND n_chars > 0 AS metadata_complete, array_to_string(list_filter(['source', CASE WHEN n_chars > 1000 THEN 'n_chars' END, 'lang'], lambda x: x IS NOT NULL), ',') AS provided, n_chars % 11 >= 5 AS is_relevant FROM documents")
def derived_flags(spark, sf):
    provided = evidence.provided({"source": F.col("source"), "n_chars": F.when(F.col("n_chars") > 1000, F.col("n_chars")), "lang": F.col("lang")})
    return table(spark, sf, "documents").select("doc_id", (F.col("source").isNotNull() & F.col("lang").isNotNull() & (F.col("n_chars") > 0)).alias("metadata_complete"), F.array_join(provided, ",").alias("provided"), (F.col("n_chars") % 11 >= 5).alias("is_relevant"))


@query("session_roundtrip", "SELECT conv_id, count(*) AS turns, substr(sha256(string_agg(role || ':' || text, chr(31) ORDER BY turn)), 1, 12) AS session_id FROM conversations GROUP BY conv_id")
def session_roundtrip(spark, sf):
    """Sessions to JSON and back with a declared schema."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    packed = table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("json"))
    back = packed.select("conv_id", F.from_json("json", "turns array<struct<turn: bigint, role: string, text: string>>").alias("s"))
    joined = F.array_join(F.transform("s.turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\x1f")
    return back.select("conv_id", F.size("s.turns").cast("long").alias("turns"), identity.digest(joined, 12).alias("session_id"))
