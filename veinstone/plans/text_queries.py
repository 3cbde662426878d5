"""Queries over text functions, keys and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations, identity, text
from ..session import spread, table
from .registry import Inline, Registry, Templates

registry = Registry()
query = registry.query

# White space as Python and Java's (?U) see it, for RE2.
_S = r"[\s\x0b\x1c-\x1f\x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANK = r"[\t\x0b\f\r\x1c-\x1f \x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _tidy(x: str) -> str:
    x = f"replace(replace({x}, chr(8203), ''), chr(65279), '')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '{_BLANK}+', ' ', 'g')"
    return _strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _tokens(x: str) -> str:
    apart = f"regexp_replace(lower({x}), '([{text.CJK}]+)', ' \\1 ', 'g')"
    runs = f"regexp_extract_all({apart}, '[{text.CJK}]+|[\\p{{L}}\\p{{N}}]+')"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[{text.CJK}]') AND length(r) > 1 THEN list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS INT), 2)) ELSE [r] END))"


def _hex(x: str, n: int = 16) -> str:
    return f"substr(sha256({x}), 1, {n})"


@query("content_hash", f"SELECT doc_id, {_hex('text')} AS content_hash, {_hex(chr(39) + 'hash:' + chr(39) + ' || ' + _hex('text'))} AS source_key FROM documents")
def content_hash(spark, sf):
    hashed = identity.digest(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", hashed.alias("content_hash"), identity.source_key(F.lit(None).cast("string"), hashed).alias("source_key"))


PAGED = Templates("id long, text string", [(1, "first page @id@\fsecond\nmore\f"), (2, "@text@"), (3, "\f\flast @source@"), (4, ""), (5, "@text@\f@text@\f@id@")])


@query("pages_split", f"SELECT id, CAST(generate_subscripts(string_split(text, chr(12)), 1) AS INT) AS page_number, unnest(string_split(text, chr(12))) AS page FROM {PAGED.values}")
def pages_split(spark, sf):
    return PAGED.df(spark, sf).select("id", F.posexplode(F.split("text", "\f")).alias("k", "page")).select("id", (F.col("k") + 1).alias("page_number"), "page")


@query("normalize_text", f"SELECT doc_id, {_tidy('text')} AS text FROM documents")
def normalize_text(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", text.normalize(F.col("text")).alias("text"))


MESSY = Templates("id long, text string", [(1, "ＡＢＣ　１２３ @id@"), (2, "a b​c﻿ @id@"), (3, "x\r\ny\rz @id@"), (4, "many   blanks\t here @id@"), (5, "a\n\n\n\n\nb @id@"), (6, "  \n edges \t @id@"), (7, "ﬁne ½ ① @id@"), (8, " @id@"), (9, None), (10, "𝟙 astral 🙂 @id@")])
MESSY_OUT = Templates("id long, text string", [(1, "ABC 123 @id@"), (2, "a bc @id@"), (3, "x\ny\nz @id@"), (4, "many blanks here @id@"), (5, "a\n\nb @id@"), (6, "edges @id@"), (7, "fine 1⁄2 1 @id@"), (8, "@id@"), (9, ""), (10, "1 astral 🙂 @id@")])


@query("normalize_cases", f"SELECT id, text FROM {MESSY_OUT.values}")
def normalize_cases(spark, sf):
    return MESSY.df(spark, sf).select("id", text.normalize(F.col("text")).alias("text"))


@query("derive_keys", f"""
SELECT doc_id, {_hex("concat_ws(chr(31), source, lang, CAST(doc_id AS VARCHAR))")} AS derived,
       {_hex("concat_ws(chr(31), source, " + _hex("text") + ", 'Intro/Setup', '3')")} AS fragment_id,
       'ev-' || {_hex("source || ':' || CAST(doc_id AS VARCHAR)", 8)} AS evidence_key
FROM documents""")
def derive_keys(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        identity.derive_key(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("derived"),
        identity.fragment_id(F.col("source"), identity.digest(F.col("text")), F.array(F.lit("Intro"), F.lit("Setup")), F.lit(3)).alias("fragment_id"),
        identity.evidence_key(F.col("source"), F.col("doc_id").cast("string")).alias("evidence_key"),
    )


@query("tokenize", rf"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, {_hex('array_to_string(t, chr(32))')} AS terms_hash FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents)")
def tokenize(spark, sf):
    t = text.tokens(F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), identity.digest(F.array_join("t", " ")).alias("terms_hash"))


MIXED = Inline("id long, text string", [(1, "科研文献"), (2, "中"), (3, "BERT模型 works"), (4, "a-b"), (5, "?!…"), (6, "第3章 検索とは"), (7, "한국어 텍스트 42"), (8, ""), (9, "été Straße"), (10, "没有足够的信息")])


_LONG = f"(SELECT id, text FROM {MIXED.values} UNION ALL SELECT doc_id + 100, text FROM documents)"


def _long(spark, sf):
    return MIXED.df(spark).unionByName(table(spark, sf, "documents").select((F.col("doc_id") + 100).alias("id"), "text"))


@query("index_terms", f"SELECT id, array_to_string({_tokens('text')}, ' ') AS terms FROM {_LONG}")
def index_terms(spark, sf):
    return _long(spark, sf).select("id", text.index_terms(F.col("text")).alias("terms"))


@query("cjk_ratio", f"SELECT id, CASE WHEN length(regexp_replace(text, '{_S}', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(text, '[^{text.CJK}]', '', 'g')) / length(regexp_replace(text, '{_S}', '', 'g'))::DOUBLE END::DOUBLE AS ratio, length(regexp_replace(text, '[^{text.CJK}]', '', 'g')) > 0 AS has_cjk FROM {_LONG}")
def cjk_ratio(spark, sf):
    return _long(spark, sf).select("id", text.cjk_ratio(F.col("text")).alias("ratio"), (text.cjk_count(F.col("text")) > 0).alias("has_cjk"))


@query("estimate_tokens", f"SELECT id, CAST(floor(length(regexp_replace(text, '[^{text.CJK}]', '', 'g')) + (length(text) - length(regexp_replace(text, '[^{text.CJK}]', '', 'g'))) / 4.0) AS BIGINT) AS n_tokens FROM {_LONG}")
def estimate_tokens(spark, sf):
    return _long(spark, sf).select("id", text.estimate_tokens(F.col("text")).alias("n_tokens"))


_IDEO = r"length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) / length(text)::DOUBLE"


@query("answer_language", f"SELECT id, CASE WHEN text = '' THEN 'none' WHEN {_IDEO} > 0.15 THEN 'zh' WHEN {_IDEO} < 0.02 THEN 'en' ELSE 'mixed' END AS language FROM {_LONG}")
def answer_language(spark, sf):
    return _long(spark, sf).select("id", text.answer_language(F.col("text")).alias("language"))


CITED = Templates("id long, text string", [(1, "see https://doi.org/10.1234/AbC@id@.5)."), (2, "@text@ doi:10.5555/x(1)y@id@, and more"), (3, "arXiv:2401.01234v2 here @id@"), (4, "@text@ ARXIV 1203.4567"), (5, "nothing 10.12/x@id@"), (6, "two 10.1000/first@id@; 10.1000/second"), (7, ""), (8, "@text@")])


@query("find_ids", f"""
SELECT id, doi, arxiv, coalesce(doi, '10.48550/arXiv.' || arxiv) AS printed_or_made FROM (
SELECT id, nullif(regexp_replace(regexp_extract(text, '(?i)\\b10\\.\\d{{4,9}}/[^\\s"''<>]+'), '[.,;:)\\]}}>"'']+$', ''), '') AS doi,
       nullif(regexp_extract(text, '(?i)arxiv[:\\s]*(\\d{{4}}\\.\\d{{4,5}})(v\\d+)?', 1), '') AS arxiv FROM {CITED.values})""")
def find_ids(spark, sf):
    made = CITED.df(spark, sf).select("id", text.find_doi(F.col("text")).alias("doi"), text.find_arxiv(F.col("text")).alias("arxiv"))
    return made.withColumn("printed_or_made", F.coalesce("doi", F.concat(F.lit("10.48550/arXiv."), "arxiv")))


DOIS = Templates("id long, doi string", [(1, "https://doi.org/10.1/ABC@id@"), (2, "http://dx.doi.org/10.1/abc@id@"), (3, "DOI: 10.1/Abc@id@ "), (4, "10.1/abc@id@"), (5, "doi.org/10.2/x@id@"), (6, ""), (7, None), (8, "  ")])
_DOI = f"nullif(lower({_strip('regexp_replace(regexp_replace(' + _tidy('doi') + ', ' + chr(39) + '(?i)^(?:https?://)?(?:dx\\.)?doi\\.org/' + chr(39) + ', ' + chr(39)*2 + '), ' + chr(39) + '(?i)^doi:\\s*' + chr(39) + ', ' + chr(39)*2 + ')')}), '')"


@query("normalize_doi", f"SELECT id, clean, {_hex('CASE WHEN clean IS NULL THEN ' + chr(39) + 'hash:' + chr(39) + ' || CAST(id AS VARCHAR) ELSE ' + chr(39) + 'doi:' + chr(39) + ' || clean END')} AS source_key FROM (SELECT id, {_DOI} AS clean FROM {DOIS.values})")
def normalize_doi(spark, sf):
    return DOIS.df(spark, sf).select("id", text.normalize_doi(F.col("doi")).alias("clean"), identity.source_key(F.col("doi"), F.col("id").cast("string")).alias("source_key"))


AUTHORS = Templates("id long, authors string", [(1, "Ada Lovelace@id@; Alan Turing"), (2, "Lovelace, Ada@id@, Turing, Alan"), (3, "Ada Lovelace@id@ and Alan Turing"), (4, "A. One@id@ & B. Two"), (5, "Lovelace@id@, Ada"), (6, "One@id@\nTwo\n"), (7, ""), (8, "A, B@id@, C"), (9, " ; X@id@ ;")])
_CLEAN = "list_filter(list_transform({}, lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '')"


@query("split_authors", f"""
SELECT id, array_to_string(CASE WHEN trim(authors) = '' THEN [] WHEN contains(authors, ';') THEN {_CLEAN.format("string_split(authors, ';')")}
  WHEN contains(authors, chr(10)) THEN {_CLEAN.format("string_split(authors, chr(10))")}
  WHEN regexp_matches(authors, ' and | & ') THEN {_CLEAN.format("string_split_regex(authors, ' and | & ')")}
  WHEN contains(authors, ',') AND len(c) > 2 AND len(c) % 2 = 0 THEN list_transform(range(0, len(c) // 2), lambda i: c[CAST(2 * i + 1 AS INT)] || ', ' || c[CAST(2 * i + 2 AS INT)])
  ELSE [trim(authors)] END, '|') AS names, CAST(0 AS BIGINT) AS zero
FROM (SELECT *, {_CLEAN.format("string_split(authors, ',')")} AS c FROM {AUTHORS.values})""")
def split_authors(spark, sf):
    return AUTHORS.df(spark, sf).select("id", F.array_join(text.split_authors(F.col("authors")), "|").alias("names"), F.lit(0).cast("long").alias("zero"))


LINES = Templates("id long, line string, next_blank boolean", [(1, "## Method @id@", False), (2, "# Title @id@ #", False), (3, "4.2 Sampling @id@", False), (4, "7 wells near @id@ ran dry", False), (5, "IV. Results @id@", False), (6, "A) Proofs @id@", False), (7, "第三章 方法@id@", False), (8, "二、实验@id@", False), (9, "INTRODUCTION", True), (10, "INTRODUCTION", False), (11, "1. This ends with a stop @id@.", False), (12, "plain text here @id@", True), (13, "", True), (14, "x" * 130, True), (15, "3.4.1 Deep Level @id@", False), (16, "1) first, second @id@,", False)])
_HEAD_OUT = Templates("id long, level int, title string", [(1, 2, "Method @id@"), (2, 1, "Title @id@"), (3, 2, "4.2 Sampling @id@"), (4, None, None), (5, 1, "IV. Results @id@"), (6, 1, "A) Proofs @id@"), (7, 1, "第三章 方法@id@"), (8, 1, "二、实验@id@"), (9, 1, "INTRODUCTION"), (10, None, None), (11, None, None), (12, None, None), (13, None, None), (14, None, None), (15, 3, "3.4.1 Deep Level @id@"), (16, None, None)])


@query("headings", f"SELECT id, level, title FROM {_HEAD_OUT.values}")
def headings(spark, sf):
    h = text.heading(F.col("line"), F.col("next_blank"))
    return LINES.df(spark, sf).select("id", h["level"].alias("level"), h["title"].alias("title"))


BLOCKS = Inline("id long, text string", [(1, "one\ntwo\n\nthree"), (2, "a\n \n\nb  c\n"), (3, ""), (4, "single")])


@query("paragraphs", f"""
SELECT id, CAST(k AS INT) AS k, p AS paragraph FROM (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS k FROM (
SELECT id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(regexp_replace(regexp_replace(p, '\\s*\\n\\s*', ' ', 'g'), ' +', ' ', 'g'))), lambda p: p <> '') AS ps FROM
(SELECT * FROM {BLOCKS.values} UNION ALL SELECT doc_id + 100, text FROM documents)))""")
def paragraphs(spark, sf):
    rows = BLOCKS.df(spark).unionByName(table(spark, sf, "documents").select((F.col("doc_id") + 100).alias("id"), "text"))
    return rows.select("id", F.posexplode(text.paragraphs(F.col("text"))).alias("k", "paragraph"))


@query("lines", "SELECT doc_id, CAST(generate_subscripts(s, 1) AS INT) AS line_no, unnest(s) AS line FROM (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))")
def lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("k", "line")).select("doc_id", (F.col("k") + 1).alias("line_no"), "line")


SPANS = Templates("id long, page_start long, page_end long", [(1, "@id@", "@id@"), (2, "@id@", "@id@9"), (3, None, None), (4, "@id@", None)])


@query("page_label", f"SELECT id, CASE WHEN page_start IS NULL THEN '' WHEN page_end IS NULL OR page_end = page_start THEN 'page ' || page_start ELSE 'pages ' || page_start || '-' || page_end END AS label FROM {SPANS.values}")
def page_label(spark, sf):
    return SPANS.df(spark, sf).select("id", text.page_label(F.col("page_start"), F.col("page_end")).alias("label"))


SOURCES = Templates(
    "id long, title string, authors array<string>, year int, doi string, venue string, oa_url string, retracted boolean",
    [
        (1, "Rivers Carry More Than Water @id@", ["Mira Okafor", "Jon Lindqvist"], 2017, "10.1/a@id@", "Hydrology & Friends", None, False),
        (2, "A Census of MOSS", ["Ferro@id@, Iris"], 2023, None, None, "https://x.org/a_b@id@", False),
        (3, "高原湖泊水质变化", ["林 远@id@"], None, None, "湖泊科学", None, True),
        (4, "of the", [], 1999, None, None, None, False),
        (5, "Costs 50% {less} ~ #@id@", ["O'Neil-Smith"], 2020, "10.2/b_c", "J^2", "u@source@", False),
    ],
)
_TOKEN = r"""CASE WHEN length(regexp_replace(title, '[^\x{4E00}-\x{9FFF}]', '', 'g')) >= 2 THEN substr(regexp_replace(title, '[^\x{4E00}-\x{9FFF}]', '', 'g'), 1, 4)
 WHEN regexp_matches(w[1], '^[A-Z]{2,}$') THEN w[1] ELSE coalesce(lower(w[1]), 'untitled') END"""
_STOP = "[" + ", ".join(f"'{w}'" for w in citations.STEM_STOP) + "]"
_STEM = rf"""coalesce(nullif(lower(regexp_replace(list_filter(string_split_regex(string_split(authors[1], ',')[1], '\s+'), lambda x: x <> '')[-1], '[^0-9A-Za-z\x{{4E00}}-\x{{9FFF}}]', '', 'g')), ''), 'anon') || coalesce(CAST(year AS VARCHAR), 'nd') || {_TOKEN}"""
_WORDS = f"(SELECT *, list_filter(string_split_regex(title, '[^0-9A-Za-z]+'), lambda x: x <> '' AND NOT list_contains({_STOP}, lower(x)) AND (regexp_matches(x, '^[A-Z]{{2,}}$') OR length(x) > 3)) AS w FROM {SOURCES.values})"


@query("citation_stem", f"SELECT id, stem, '(' || stem || ' page ' || id || ')' AS inline FROM (SELECT id, {_STEM} AS stem FROM {_WORDS})")
def citation_stem(spark, sf):
    made = SOURCES.df(spark, sf).select("id", citations.stem(F.col("authors"), F.col("year"), F.col("title")).alias("stem"))
    return made.withColumn("inline", citations.inline(F.col("stem"), F.concat(F.lit("page "), "id")))


def _escaped(x: str) -> str:
    cases = " ".join(f"WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}" for k, v in citations.BIBTEX.items())
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE c {cases} ELSE c END), '')"


@query("bibtex", f"""
SELECT id, '@' || kind || '{{' || regexp_replace(stem, '[\\s,(){{}}\\[\\]"''\\\\~#%&=]', '', 'g') || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{' || {_escaped('title')} || '}}',
  CASE WHEN len(authors) > 0 THEN '  author = {{' || {_escaped("array_to_string(authors, ' and ')")} || '}}' END, '  year = {{' || year || '}}', '  journal = {{' || {_escaped('venue')} || '}}',
  '  doi = {{' || {_escaped('doi')} || '}}', '  url = {{' || {_escaped('oa_url')} || '}}', CASE WHEN venue IS NULL THEN '  howpublished = {{Preprint}}' END, CASE WHEN retracted THEN '  note = {{RETRACTED}}' END) || chr(10) || '}}' AS entry
FROM (SELECT *, CASE WHEN venue IS NULL THEN 'misc' ELSE 'article' END AS kind, {_STEM} AS stem FROM {_WORDS})""")
def bibtex(spark, sf):
    return SOURCES.df(spark, sf).select("id", citations.bibtex(F.struct("title", "authors", "year", "doi", "venue", "oa_url", "retracted")).alias("entry"))


_UNESCAPED = "html"
for _e, _c in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&middot;?", "·"), ("&copy;?", "©"), ("&amp;?", "&")):
    _UNESCAPED = f"regexp_replace({_UNESCAPED}, '{_e}', '{_c}', 'g')"


@query("strip_markup", f"SELECT page_id, nullif({_tidy(f'regexp_replace({_UNESCAPED}, {chr(39)}</?[A-Za-z][^<>]*>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '') AS text FROM pages")
def strip_markup(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", text.strip_markup(F.col("html")).alias("text"))


TITLES = Templates("id long, a string, b string", [(1, "Rivers carry your water @id@", "Water carry RIVERS all @id@"), (2, "Deep Learning for the Web", "Deep learning: web @id@"), (3, "大模型 综述@id@", "大模型 调查"), (4, "", "x@id@"), (5, "the of", "the of"), (6, "Graph Neural Networks @source@", "语言模型"), (7, "@text@", "License @source@")])
_TSTOP = "[" + ", ".join(f"'{w}'" for w in text.TITLE_STOP) + "]"


def _title(x: str) -> str:
    return f"list_distinct(list_filter({_tokens(x)}, lambda t: regexp_matches(t, '[{text.CJK}]') OR (length(t) > 2 AND NOT list_contains({_TSTOP}, t))))"


@query("title_jaccard", f"SELECT id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END::DOUBLE AS similarity FROM (SELECT id, {_title('a')} AS x, {_title('b')} AS y FROM {TITLES.values})")
def title_jaccard(spark, sf):
    return TITLES.df(spark, sf).select("id", text.jaccard(text.title_tokens(F.col("a")), text.title_tokens(F.col("b"))).alias("similarity"))


SCORES = Templates("id long, value string", [(1, "8"), (2, "8.4"), (3, "8.6"), (4, "8/10"), (5, "3/5"), (6, "8 分"), (7, None), (8, ""), (9, "none"), (10, "12"), (11, "8/0"), (12, "2.5"), (13, "3.5"), (14, "x/3"), (15, "score: 7 of 9"), (16, "1.2.3"), (17, "@id@"), (18, "@id@/20000"), (19, "about 0.@id@ @source@")])


@query("coerce_relevance", f"""
SELECT id, CAST(least(10, greatest(0, coalesce(round_even(CASE WHEN contains(value, '/') THEN TRY_CAST(trim(string_split(value, '/')[1]) AS DOUBLE) / nullif(TRY_CAST(trim(string_split(value, '/')[2]) AS DOUBLE), 0) * 10
  ELSE TRY_CAST(nullif(regexp_extract(value, '[\\d.]+'), '') AS DOUBLE) END, 0), 0))) AS INT) AS relevance FROM {SCORES.values}""")
def coerce_relevance(spark, sf):
    return SCORES.df(spark, sf).select("id", text.coerce_relevance(F.col("value")).alias("relevance"))


# The phrases by which an answer refuses, and the form of its keys.
ANSWERS = Templates("id long, answer string", [(1, "INSUFFICIENT_EVIDENCE"), (2, "证据不足，无法判断"), (3, "x" * 130 + "证据不足"), (4, "证据不足" + "y" * 130 + "@id@"), (5, "All good @id@ (ev-0123abcd)."), (6, ""), (7, "@text@ (ev-0123abcd, ev-ffffffff) b ev-0123abcd"), (8, "bad ev-0123abcdef and ev-XYZ"), (9, "@text@ INSUFFICIENT_EVIDENCE"), (10, "@text@")])
_PHRASES = " OR ".join(f"contains(seen, '{p}')" for p in text.REFUSAL_PHRASES)


@query("is_refusal", f"SELECT id, contains(answer, 'INSUFFICIENT_EVIDENCE') OR {_PHRASES} AS refused FROM (SELECT *, CASE WHEN length(answer) <= 120 THEN answer ELSE substr(answer, 1, 20) END AS seen FROM {ANSWERS.values})")
def is_refusal(spark, sf):
    return ANSWERS.df(spark, sf).select("id", text.is_refusal(F.col("answer")).alias("refused"))


@query("extract_keys", f"SELECT id, coalesce(string_agg(key, ',' ORDER BY first), '') AS keys FROM (SELECT id, answer FROM {ANSWERS.values}) a LEFT JOIN (SELECT id AS i, key, min(k) AS first FROM (SELECT id, unnest(x) AS key, generate_subscripts(x, 1) AS k FROM (SELECT id, regexp_extract_all(answer, '\\bev-[0-9a-f]{{8}}\\b') AS x FROM {ANSWERS.values})) GROUP BY 1, 2) b ON id = i GROUP BY id")
def extract_keys(spark, sf):
    return ANSWERS.df(spark, sf).select("id", F.array_join(text.evidence_keys(F.col("answer")), ",").alias("keys"))


RAW_TITLES = Templates("id long, raw string", [(1, '"Title: A Study @id@"'), (2, "标题：检索增强@id@"), (3, "Two @id@\nlines"), (4, ""), (5, None), (6, "z" * 301 + "@id@"), (7, "“Quoted @id@”"), (8, "Title:  Spaces @id@ ")])


@query("clean_title", f"""
SELECT id, CASE WHEN length(t) BETWEEN 1 AND 300 THEN t END AS title FROM (
SELECT id, trim(string_split(trim(regexp_replace(trim(trim(coalesce(raw, '')), '"''“”‘’ ' || chr(10)), '^(?:Title:|标题：|标题:|题目：|题目:)', '')), chr(10))[1]) AS t FROM {RAW_TITLES.values})""")
def clean_title(spark, sf):
    return RAW_TITLES.df(spark, sf).select("id", text.clean_title(F.col("raw")).alias("title"))


@query("truncate_mid", "SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE substr(text, 1, 2000) || chr(10) || '… (' || (length(text) - 4000) || ' characters left out) …' || chr(10) || right(text, 2000) END AS text FROM documents")
def truncate_mid(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_middle(F.col("text")).alias("text"))


# Fixed value: the form of prose tokens.
@query("prose_tokens", r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, substr(sha256(array_to_string(t, chr(31))), 1, 16) AS hash FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_'']*|\d+(?:\.\d+)*|[^\sA-Za-z0-9_]') AS t FROM documents)")
def prose_tokens(spark, sf):
    t = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_']*|\d+(?:\.\d+)*|[^\sA-Za-z0-9_]"), F.lit(0))
    return spread(table(spark, sf, "documents")).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), identity.digest(F.array_join("t", "\x1f")).alias("hash"))
