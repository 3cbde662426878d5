"""Queries over corpus overlap; `documents` are the target and `benchmark` is the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import overlap
from ..session import spread, table
from . import audit
from .registry import Registry

registry = Registry()
query = registry.query

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_PROSE = r"regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_'']*|\d+(?:\.\d+)*|[^\sA-Za-z0-9_]')"


def _prose():
    return F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_']*|\d+(?:\.\d+)*|[^\sA-Za-z0-9_]"), F.lit(0))


def _grams(t: str, i: str, n: int, tok: str) -> str:
    return f"SELECT DISTINCT id, array_to_string(t[CAST(k AS INT):CAST(k + {n - 1} AS INT)], chr(31)) AS gram FROM (SELECT {i} AS id, {tok} AS t FROM {t}), unnest(range(1, len(t) - {n - 2})) AS u(k)"


def _contained(n: int, tok: str) -> str:
    return f"""
WITH t AS ({_grams('documents', 'doc_id', n, tok)}), r AS (SELECT DISTINCT gram FROM ({_grams('benchmark', 'item_id', n, tok)})),
s AS (SELECT id, count(*) AS shared FROM t WHERE gram IN (SELECT gram FROM r) GROUP BY id)
SELECT t.id, count(*) AS total, any_value(s.shared) AS shared, round(any_value(s.shared) / count(*)::DOUBLE, 6) AS containment, count(*) < 300 AS exempt FROM t JOIN s ON t.id = s.id GROUP BY t.id"""


@query("ngram_containment", _contained(8, _TOK))
def ngram_containment(spark, sf):
    tokens = text.tokens(F.col("text"))
    return overlap.containment(overlap.ngram_rows(spread(table(spark, sf, "documents")), "doc_id", tokens, 8), overlap.ngram_rows(table(spark, sf, "benchmark"), "item_id", tokens, 8))


@query("doc_containment", _contained(12, _PROSE))
def doc_containment(spark, sf):
    return overlap.containment(overlap.ngram_rows(spread(table(spark, sf, "documents")), "doc_id", _prose(), 12), overlap.ngram_rows(table(spark, sf, "benchmark"), "item_id", _prose(), 12))


@query("ngram_jaccard", f"""
WITH t AS (SELECT DISTINCT gram FROM ({_grams('documents', 'doc_id', 8, _TOK)})), r AS (SELECT DISTINCT gram FROM ({_grams('benchmark', 'item_id', 8, _TOK)})),
n AS (SELECT (SELECT count(*) FROM t) AS target, (SELECT count(*) FROM r) AS reference, (SELECT count(*) FROM t WHERE gram IN (SELECT gram FROM r)) AS shared)
SELECT *, round(shared / target::DOUBLE, 6) AS containment, round(shared / (target + reference - shared)::DOUBLE, 6) AS jaccard FROM n""")
def ngram_jaccard(spark, sf):
    tokens = text.tokens(F.col("text"))
    return overlap.jaccard(overlap.ngram_rows(spread(table(spark, sf, "documents")), "doc_id", tokens, 8), overlap.ngram_rows(table(spark, sf, "benchmark"), "item_id", tokens, 8))


_RUNGS = " UNION ALL ".join(f"SELECT id, {n} AS run FROM ({_grams('documents', 'doc_id', n, _TOK)}) WHERE gram IN (SELECT gram FROM ({_grams('benchmark', 'item_id', n, _TOK)}))" for n in overlap.LADDER)


@query("common_run_ladder", f"SELECT id, CAST(max(run) AS INT) AS run FROM ({_RUNGS}) GROUP BY id")
def common_run_ladder(spark, sf):
    return overlap.longest_rung(spread(table(spark, sf, "documents")), table(spark, sf, "benchmark"), ("doc_id", "item_id"), text.tokens(F.col("text")))


def _lines(t: str, i: str) -> str:
    return f"SELECT * FROM (SELECT {i} AS id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line_no, trim(unnest(string_split(text, chr(10)))) AS line FROM {t}) WHERE length(line) >= 12"


_COPIES = f"SELECT t.id, t.line_no, r.id AS ref_id, r.line_no AS ref_line, t.line FROM ({_lines('documents', 'doc_id')}) t JOIN ({_lines('benchmark', 'item_id')}) r ON t.line = r.line"


def _copies(spark, sf):
    return overlap.line_copies(overlap.line_rows(table(spark, sf, "documents"), "doc_id"), overlap.line_rows(table(spark, sf, "benchmark"), "item_id"))


@query("line_copies", _COPIES)
def line_copies(spark, sf):
    return _copies(spark, sf)


@query("aligned_blocks", f"""
SELECT id, ref_id, count(*) AS length, min(line_no) AS line_no_start, min(ref_line) AS ref_line_start FROM (
SELECT *, line_no - row_number() OVER (PARTITION BY id, ref_id, ref_line - line_no ORDER BY line_no) AS run FROM (SELECT DISTINCT id, ref_id, line_no, ref_line FROM ({_COPIES})))
GROUP BY id, ref_id, ref_line - line_no, run HAVING count(*) >= 2""")
def aligned_blocks(spark, sf):
    return overlap.aligned_blocks(_copies(spark, sf))


@query("common_tokens", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term HAVING count(*) >= greatest(1, ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE))")
def common_tokens(spark, sf):
    return overlap.common_tokens(table(spark, sf, "documents"), "doc_id", text.tokens(F.col("text")))


@query("near_string_lev", """
WITH t AS (SELECT part.p_partkey AS id, p_name AS s FROM part), r AS (SELECT p_type AS s, min(p_partkey) AS id FROM part GROUP BY p_type)
SELECT id, ref_id, CAST(distance AS INT) AS distance FROM (SELECT t.id, r.id AS ref_id, levenshtein(t.s, r.s) AS distance, row_number() OVER (PARTITION BY t.id ORDER BY levenshtein(t.s, r.s), r.id) AS n
FROM t JOIN r ON abs(length(t.s) - length(r.s)) <= 10 WHERE levenshtein(t.s, r.s) <= 12) WHERE n = 1""")
def near_string_lev(spark, sf):
    """Edit distance stands for the longest-match ratio: a different measure with the same shape of join."""
    part = table(spark, sf, "part")
    return overlap.nearest_string(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("s")), part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("s")))


@query("exact_dup", "SELECT d.doc_id AS id, min(e.doc_id) AS ref_id FROM documents d JOIN documents e ON sha256(d.text) = sha256(e.text) WHERE length(d.text) > 0 GROUP BY d.doc_id")
def exact_dup(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return overlap.exact_copies(docs, docs)


_VOCAB = "SELECT DISTINCT unnest({}) AS term FROM {}"


@query("vocab_intersect", f"{_VOCAB.format(_TOK, 'documents')} INTERSECT {_VOCAB.format(_TOK, 'benchmark')}")
def vocab_intersect(spark, sf):
    a, b = (table(spark, sf, t).select(F.explode(text.tokens(F.col("text"))).alias("term")) for t in ("documents", "benchmark"))
    return a.intersect(b)


@query("vocab_except", f"{_VOCAB.format(_TOK, 'benchmark')} EXCEPT {_VOCAB.format(_TOK, 'documents')}")
def vocab_except(spark, sf):
    a, b = (table(spark, sf, t).select(F.explode(text.tokens(F.col("text"))).alias("term")) for t in ("documents", "benchmark"))
    return b.subtract(a)


@query("vocab_union", f"{_VOCAB.format(_TOK, 'documents')} UNION {_VOCAB.format(_TOK, 'benchmark')}")
def vocab_union(spark, sf):
    a, b = (table(spark, sf, t).select(F.explode(text.tokens(F.col("text"))).alias("term")) for t in ("documents", "benchmark"))
    return a.union(b).distinct()


_BARE = "trim(" + "translate(line, '()[]{},:;', '')" + ")"
_GENERIC = f"{_BARE} = '' OR {_BARE} IN ('else', 'try', 'finally', 'pass', 'break', 'continue', 'return', 'do', 'end', 'begin', 'default')"


@query("line_tiers", f"""
WITH c AS (SELECT list(term) AS common FROM (SELECT term FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term HAVING count(*) >= greatest(1, ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE)))),
l AS ({_lines('documents', 'doc_id')})
SELECT id, line_no, CASE WHEN regexp_matches(line, '^import [A-Za-z_][\\w.]*( as \\w+)?(, *[A-Za-z_][\\w.]*( as \\w+)?)*$') OR regexp_matches(line, '^from [.\\w]+ import [\\w*(]') OR regexp_matches(line, '^if __name__ ?== ?') THEN 'boilerplate' WHEN {_GENERIC} OR len(list_filter(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains(common, w))) = 0 THEN 'generic' ELSE 'substantive' END AS tier FROM l, c""")
def line_tiers(spark, sf):
    docs = table(spark, sf, "documents")
    # Words of a tenth of all documents: few, by their own definition at most ten times a document's mean number of words.
    common = overlap.common_tokens(docs, "doc_id", text.tokens(F.col("text"))).agg(F.collect_list("term").alias("common"))
    return overlap.line_rows(docs, "doc_id").join(F.broadcast(common)).select("id", "line_no", overlap.line_tier(F.col("line"), F.col("common")).alias("tier"))


@query("audit_report", f"""
WITH b AS (SELECT coalesce(max(length), 0) AS longest FROM (SELECT id, count(*) AS length FROM (SELECT *, line_no - row_number() OVER (PARTITION BY id, ref_id, ref_line - line_no ORDER BY line_no) AS run FROM (SELECT DISTINCT id, ref_id, line_no, ref_line FROM ({_COPIES}))) GROUP BY id, ref_id, ref_line - line_no, run)),
n AS ({_contained(8, _TOK)})
SELECT 'ngrams' AS name, CAST(count(*) AS BIGINT) AS found, count(*) FILTER (NOT exempt AND containment > 0.05) > 0 AS failed FROM n
UNION ALL SELECT 'blocks', CAST(longest AS BIGINT), longest >= 5 FROM b
UNION ALL SELECT 'lines', count(*), count(*) > 0 FROM ({_COPIES})
UNION ALL SELECT 'assets', count(*), count(*) > 0 FROM documents WHERE text IN (SELECT text FROM benchmark)""")
def audit_report(spark, sf):
    docs, ref = spread(table(spark, sf, "documents")), table(spark, sf, "benchmark")
    return audit.checks(docs.select(F.col("doc_id").alias("id"), "text"), ref.select(F.col("item_id").alias("id"), "text"))
