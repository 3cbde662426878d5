"""Text functions as column expressions; Python only where the engine has no Unicode normalisation."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import CHAPTER_NUMERALS, CHAPTER_UNITS, LIST_MARKS, LIST_NUMERALS

# The ranges that count as CJK (ideographs, extensions A and B, compatibility, kana, hangul).
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"

SPACE_RUN = r"(?U)[^\S\n]+"
EDGES = r"(?U)^\s+|\s+$"


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII texts, for which it does nothing, don't leave the JVM."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, F.pandas_udf(_nfkc, "string")(F.when(other, text))).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, EDGES, "")


def tidy_space(text: Column) -> Column:
    """normalize() but for the Unicode form: line ends, runs of blanks, three and more line ends, both ends."""
    text = F.translate(text, "​﻿", "")
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, SPACE_RUN, " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize(text: Column) -> Column:
    """The canonical form of a text; null becomes empty. For bytes of unknown worth there is from_bytes()."""
    return tidy_space(F.coalesce(nfkc(text), F.lit("")))


def from_bytes(data: Column) -> Column:
    """The canonical form of UTF-8 bytes; each part that is not valid, lone surrogates too, becomes the replacement character."""
    return normalize(F.make_valid_utf8(data.cast("string")))


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers; of a run of CJK characters its overlapping pairs (or the only character)."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(text.rlike(f"[{CJK}]"), _mixed_tokens(text)).otherwise(plain)


def _mixed_tokens(text: Column) -> Column:
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[{CJK}]+|[[\\p{{L}}\\p{{N}}]&&[^{CJK}]]+"), F.lit(0))
    pair = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]") & (F.length(r) > 1), pair(r)).otherwise(F.array(r))))


def index_terms(text: Column) -> Column:
    """What both sides of a full-text index see."""
    return F.array_join(tokens(normalize(text)), " ")


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{CJK}]", ""))


def cjk_ratio(text: Column) -> Column:
    """The share of CJK among the characters that aren't white space; 0 if there are none."""
    full = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.coalesce(F.try_divide(cjk_count(text), full), F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """A rough number of model tokens: one for a CJK character, a quarter for any other."""
    cjk = cjk_count(text)
    return F.coalesce(F.floor(cjk + (F.length(text) - cjk) / 4), F.lit(0)).cast("long")


def answer_language(text: Column) -> Column:
    """zh, en, mixed or none, by the share of ideographs."""
    ratio = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", "")) / F.length(text)
    return F.when(F.coalesce(text, F.lit("")) == "", "none").when(ratio > 0.15, "zh").when(ratio < 0.02, "en").otherwise("mixed")


def find_doi(text: Column) -> Column:
    """The first DOI in a text, without the closing marks and brackets at its end."""
    found = F.regexp_extract(text, r"(?i)\b10\.\d{4,9}/[^\s\"'<>]+", 0)
    found = F.regexp_replace(found, r"""[.,;:)\]}>"']+$""", "")
    return F.nullif(found, F.lit(""))


def find_arxiv(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)arxiv[:\s]*(\d{4}\.\d{4,5})(v\d+)?", 1), F.lit(""))


def normalize_doi(doi: Column) -> Column:
    """Lower-cased, without a resolver's address or a doi: in front; null if nothing is left."""
    bare = F.regexp_replace(tidy_space(doi), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")
    return F.nullif(F.lower(strip(F.regexp_replace(bare, r"(?i)^doi:\s*", ""))), F.lit(""))


def split_authors(text: Column) -> Column:
    """Names of an author string: cut at semicolons, else line ends, else `and` or `&`, else pairs of commas, else whole."""
    clean = lambda parts: F.filter(F.transform(parts, strip), lambda x: x != "")
    commas = clean(F.split(text, ","))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(commas) / 2).cast("int") - 1), lambda i: F.concat(F.get(commas, 2 * i), F.lit(", "), F.get(commas, 2 * i + 1)))
    return (
        F.when(strip(text) == "", F.array().cast("array<string>"))
        .when(F.instr(text, ";") > 0, clean(F.split(text, ";")))
        .when(F.instr(text, "\n") > 0, clean(F.split(text, "\n")))
        .when(text.rlike(" and | & "), clean(F.split(text, " and | & ")))
        .when((F.instr(text, ",") > 0) & (F.size(commas) > 2) & (F.size(commas) % 2 == 0), pairs)
        .otherwise(F.array(strip(text)))
    )


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, their lines joined by a blank."""
    joined = lambda p: tidy_space(F.regexp_replace(p, r"\s*\n\s*", " "))
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), joined), lambda p: p != "")


#: Where lines end: line feed, carriage return, vertical tab, form feed, separators, next line, U+2028 and U+2029.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def lines(text: Column) -> Column:
    """Lines of a text; an end of line at its end starts no line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def page_label(start: Column, end: Column) -> Column:
    """page 3, pages 3-4, or empty."""
    one = F.concat(F.lit("page "), start)
    return F.when(start.isNull(), "").when(end.isNull() | (end == start), one).otherwise(F.concat(F.lit("pages "), start, F.lit("-"), end))


# Fixed value: what counts as a tag; a sign before anything else is a comparison.
TAG = "</?[A-Za-z][^<>]*>"


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def strip_markup(markup: Column) -> Column:
    """Character references decoded, then tags out; what looks like a comparison stays. Null if nothing is left."""
    coded = F.contains(markup, F.lit("&"))
    text = F.when(coded, F.pandas_udf(_unescaped, "string")(F.when(coded, markup))).otherwise(markup)
    return F.nullif(tidy_space(F.regexp_replace(text, TAG, " ")), F.lit(""))


# Words that don't tell titles apart.
TITLE_STOP = ("about", "after", "against", "all", "also", "among", "and", "another", "any", "are", "because", "been", "before", "between", "both", "but", "can", "could", "did", "does", "doing", "done", "during", "each", "few", "for", "from", "further", "had", "has", "have", "here", "how", "into", "its", "just", "more", "most", "not", "only", "other", "our", "out", "over", "own", "same", "should", "some", "such", "than", "that", "the", "their", "then", "there", "these", "they", "this", "those", "through", "toward", "towards", "under", "upon", "using", "very", "via", "was", "were", "what", "when", "where", "which", "while", "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "your")


def title_tokens(title: Column) -> Column:
    """Distinct tokens that tell a title apart: CJK pairs, and words of three letters and more but stop words."""
    stop = F.array(*map(F.lit, TITLE_STOP))
    return F.array_distinct(F.filter(tokens(title), lambda t: t.rlike(f"[{CJK}]") | ((F.length(t) > 2) & ~F.array_contains(stop, t))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def coerce_relevance(value: Column) -> Column:
    """A relevance from 0 to 10 from what a model wrote: 8, 8.4, 8/10, or the first number in it; halves to even."""
    text = strip(value)
    parts = F.split(text, "/", 2)
    ratio = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")) * 10
    first = F.nullif(F.regexp_extract(text, r"[\d.]+", 0), F.lit("")).try_cast("double")
    number = F.when(F.instr(text, "/") > 0, ratio).otherwise(first * F.when(text.rlike(r"^-\s*[\d.]+$"), -1).otherwise(1))
    return F.least(F.lit(10), F.greatest(F.lit(0), F.coalesce(F.bround(number), F.lit(0.0)).cast("int")))


# What a model says when it can't answer.
REFUSAL_SENTINEL = "INSUFFICIENT_EVIDENCE"
REFUSAL_PHRASES = ("证据不足", "无法回答", "没有足够的信息", "资料不足")


def is_refusal(text: Column) -> Column:
    """The sentinel anywhere, or a phrase in a short answer or at the head of a long one."""
    bare = strip(text)
    seen = F.when(F.length(bare) <= 120, bare).otherwise(F.substring(bare, 1, 20))
    phrase = F.lit(False)
    for p in REFUSAL_PHRASES:
        phrase = phrase | F.contains(seen, F.lit(p))
    return F.coalesce(F.contains(bare, F.lit(REFUSAL_SENTINEL)) | phrase, F.lit(False))


def evidence_keys(text: Column) -> Column:
    """Evidence keys in the order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bev-[0-9a-f]{8}\b"), F.lit(0)))


def clean_title(text: Column) -> Column:
    """The first line of an inferred title without quotes or a label; null if empty or over 300 characters."""
    marks = "\"'“”‘’ \n"
    bare = F.btrim(strip(F.coalesce(text, F.lit(""))), F.lit(marks))
    bare = strip(F.regexp_replace(bare, "^(?:Title:|标题：|标题:|题目：|题目:)", ""))
    first = strip(F.get(lines(bare), F.lit(0)))
    return F.when((F.length(first) > 0) & (F.length(first) <= 300), first)


# What programs write where a title should be.
NO_TITLE = ("untitled", "unknown", "document", "microsoft word")
NO_TITLE_ENDS = (".doc", ".docx", ".tex", ".indd")


def is_placeholder_title(title: Column, stem: Column | None = None) -> Column:
    """Whether a file's own title says nothing: a program's default, a file name, or the name `stem` of this file."""
    own = F.lower(strip(title))
    tests = [own.isin(*NO_TITLE), own.contains("untitled"), *(own.endswith(e) for e in NO_TITLE_ENDS)]
    if stem is not None:
        tests.append(own == F.lower(strip(stem)))
    found = F.lit(False)
    for test in tests:
        found = found | F.coalesce(test, F.lit(False))
    return found


def is_key_stem(stem: Column) -> Column:
    """Whether a file name may be a citation key: eight characters or more, letters and digits, no blank."""
    return F.coalesce((F.length(stem) >= 8) & stem.rlike(r"\p{Nd}") & stem.rlike(r"\p{L}") & ~stem.contains(" "), F.lit(False))


def truncate_middle(text: Column, limit: int = 4000) -> Column:
    """Head and tail of an observation that is too long, with the number of characters left out."""
    head, tail = limit // 2, limit - limit // 2
    short = F.concat(F.substring(text, 1, head), F.lit("\n… ("), (F.length(text) - limit).cast("string"), F.lit(" characters left out) …\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= limit, text).otherwise(short)


def first_line(text: Column, limit: int = 200) -> Column:
    """The first line that isn't blank, cut to `limit`."""
    full = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    return F.substring(F.coalesce(F.get(full, F.lit(0)), F.lit("")), 1, limit)


def heading(line: Column, next_blank: Column) -> Column:
    """struct(level, title) of a line that is a heading, else null; the rules are those of structure.heading.

    The first word decides: number signs; a number in parts, a Roman number or a letter, with or without
    a mark; a CJK number. Any other line is one if it is in capitals before a blank line.
    """
    bare = strip(line)
    made = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"))
    full = lambda x: F.length(strip(x)) > 0
    first = F.split(bare, r"(?U)\s", 2)[0]
    rest = strip(F.substring(bare, F.length(first) + 1, F.length(bare)))
    signs = (F.length(first) <= 6) & (F.rtrim(first, F.lit("#")) == "") & (F.length(line) - F.length(F.regexp_replace(line, r"(?U)^\s+", "")) <= 3)
    title = strip(F.rtrim(rest, F.lit("#")))
    title = F.when(title != "", title).otherwise(F.substring(rest, 1, 1))
    inner = F.ltrim(F.substring(bare, 2, F.length(bare)))
    unit = F.ltrim(inner, F.lit(CHAPTER_NUMERALS))
    behind = F.ltrim(unit)
    chapter = (F.substring(bare, 1, 1) == "第") & (F.length(unit) < F.length(inner)) & F.contains(F.lit(CHAPTER_UNITS), F.substring(behind, 1, 1)) & full(F.substring(behind, 2, F.length(behind)))
    listed = F.ltrim(bare, F.lit(LIST_NUMERALS))
    item = (F.length(listed) < F.length(bare)) & F.contains(F.lit(LIST_MARKS), F.substring(listed, 1, 1)) & full(F.substring(listed, 2, F.length(listed)))
    marked = (F.length(first) > 1) & F.substring(first, -1, 1).isin(".", ")")
    parts = F.split(F.when(marked, F.substring(first, 1, F.length(first) - 1)).otherwise(first), r"\.")
    digits = lambda x: (x != "") & (F.translate(x, "0123456789", "") == "")
    numeric = F.forall(parts, digits)
    other = (F.size(parts) == 1) & (parts[0] != "") & ((F.translate(parts[0], "IVXLC", "") == "") | ((F.length(parts[0]) == 1) & parts[0].between("A", "Z")))
    numbered = (rest != "") & (numeric | other) & (marked | (numeric & F.substring(rest, 1, 1).rlike(r"\p{Lu}") & (F.length(bare) <= 60)))
    capitals = next_blank & F.length(bare).between(3, 60) & (bare == F.upper(bare)) & bare.rlike(r"\p{L}") & ~bare.rlike(r"\p{Ll}")
    return (
        F.when((bare == "") | (F.length(bare) > 120), None)
        .when(signs & (title != ""), made(F.length(first), title))
        .when(F.contains(F.lit("。.!?;,，"), F.substring(bare, -1, 1)), None)
        .when(chapter | item, made(F.lit(1), bare))
        .when(numbered, made(F.size(parts), bare))
        .when(capitals, made(F.lit(1), bare))
    )
