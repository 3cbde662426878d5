"""Queries over names, strings, spans, tool calls and broken text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, toolcalls
from ..session import spread, table
from .registry import Registry

registry = Registry()
query = registry.query


_NAMES = "SELECT DISTINCT w AS name FROM (SELECT lower(regexp_extract(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE w <> ''"


@query("identifier_hits", f"SELECT doc_id, name, CAST(count(*) AS INT) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS name FROM documents) WHERE name IN ({_NAMES}) GROUP BY ALL")
def identifier_hits(spark, sf):
    """Whole-word hits of the first words of all benchmark items, by one automaton in one pass over the documents."""
    first = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("w")).where("w <> ''").distinct()
    names = sorted(r.w for r in first.collect())  # what is looked for is a list that people keep
    return audit.name_hits(spread(table(spark, sf, "documents")).select("doc_id", "text"), names)


@query("near_strings")
def near_strings(spark, sf):
    """The nearest of all kinds of parts, by the matching ratio, to each name of a part with its brand."""
    part = table(spark, sf, "part")
    names = part.select(F.concat_ws(" ", "p_brand", "p_name").alias("s"))
    kinds = part.select(F.concat_ws(" ", F.lower("p_type"), "p_name", F.lit("brand")).alias("s"))
    return audit.nearest_strings(names, kinds, 0.6, 12)


@query("page_spans", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS BIGINT) AS comments, length(html) AS n_chars,
       CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '</?[A-Za-z][^<>]*>')) AS BIGINT) AS tags FROM pages WHERE length(html) > 0""")
def page_spans(spark, sf):
    """Spans of raw pages by a table function in a lateral join: together they are the whole page."""
    made = audit.spanned(spread(table(spark, sf, "pages")).select("page_id", "html"), "html", "'.html'")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return made.groupBy("page_id").agg(count("comment").alias("comments"), F.sum(F.length("part")).alias("n_chars"), count("tag").alias("tags"))


@query("tool_calls", "SELECT conv_id, turn, 'call-0' AS call, role AS name, text, CAST(NULL AS VARCHAR) AS unread FROM conversations UNION ALL SELECT conv_id, turn, CAST(turn AS VARCHAR), 'finish', NULL, NULL FROM conversations UNION ALL SELECT conv_id, turn, 'call-2', 'broken', NULL, 'no JSON: ' || turn FROM conversations")
def tool_calls(spark, sf):
    """Each turn as a reply with three calls: one with arguments, one without, one that can't be read."""
    rows = table(spark, sf, "conversations")
    call = lambda name, arguments, ident=None: F.struct(F.lit(None).cast("string").alias("id") if ident is None else ident.alias("id"), F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"))
    listed = F.array(call(F.col("role"), F.to_json(F.struct("text"))), call(F.lit("finish"), F.lit(""), F.col("turn").cast("string")), call(F.lit("broken"), F.concat(F.lit("no JSON: "), F.col("turn").cast("string"))))
    replies = rows.select("conv_id", "turn", F.to_json(F.struct(listed.alias("tool_calls"))).alias("reply"))
    each = replies.select("conv_id", "turn", F.explode(toolcalls.calls(F.col("reply"))).alias("c")).select("conv_id", "turn", F.col("c.id").alias("call"), "c.name", toolcalls.read(F.col("c.raw")).alias("r"))
    return each.select("conv_id", "turn", "call", "name", F.get_json_object("r.arguments", "$.text").alias("text"), "r.unread")


@query("utf8_repair", "SELECT doc_id, md5('start ' || chr(65533) || ' ' || doc_id || CASE doc_id % 3 WHEN 0 THEN repeat(chr(65533), 3) WHEN 1 THEN chr(65533) ELSE 'é' END || ' ' || trim(regexp_replace(text, '[^a-z]+', ' ', 'g')) || 'x') AS digest FROM documents")
def utf8_repair(spark, sf):
    """Texts as bytes with a wrong byte, and a lone surrogate, a cut sequence, or a good letter."""
    kind = F.pmod("doc_id", F.lit(3))
    planted = F.when(kind == 0, F.lit(b"\xed\xa0\x80")).when(kind == 1, F.lit(b"\xe4\xb8")).otherwise(F.lit("é".encode()))
    plain = F.trim(F.regexp_replace("text", "[^a-z]+", " "))
    data = F.concat(F.lit(b"start \xff "), F.encode(F.col("doc_id").cast("string"), "UTF-8"), planted, F.lit(b" "), F.encode(plain, "UTF-8"), F.lit(b"x"))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode(text.from_bytes(data), "UTF-8")).alias("digest"))
