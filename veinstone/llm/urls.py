"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

The vocabulary is a table of terms of several languages with weights: a term of `limit` and more is strict, the others are soft. A term
counts where it stands between characters that are neither ASCII letters nor digits; one strict term, or distinct soft terms
whose weights add up to `limit`, block the url.

Null urls, and urls without `://`, have an empty host and path, fit no rule and are judged by the
vocabulary alone (null: allow). Repeated rows are judged alike; columns of the input other than the
id and the url are left out, so that none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Weights of distinct terms that make a block together: one strict term, or two soft ones.
LIMIT = 2


class Term(NamedTuple):
    term: str
    weight: int
    language: str


def read_terms(path: str | None = None) -> tuple[Term, ...]:
    """The weighted vocabulary of a CSV file (term, weight, language); that of this package without a path."""
    with open(path or os.path.join(os.path.dirname(__file__), "url_terms.csv"), encoding="utf-8", newline="") as f:
        return tuple(Term(r["term"].lower(), int(r["weight"]), r["language"]) for r in csv.DictReader(f))


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


class Vocabulary:
    """An automaton over all terms; made once in each Python worker."""

    def __init__(self, terms: Iterable[Term], limit: int = LIMIT):
        import ahocorasick

        self.found, self.limit = ahocorasick.Automaton(), limit
        for t in terms:
            self.found.add_word(t.term, t)
        if len(self.found):
            self.found.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int, int]:
        """How many strict terms, and how many distinct soft terms, stand in the url, and the weight of those."""
        if not url or not len(self.found):
            return 0, 0, 0
        text, strict, soft = url.lower(), 0, set()
        for end, t in self.found.iter(text):
            before, after = text[end - len(t.term)] if end >= len(t.term) else "", text[end + 1 : end + 2]
            if not _part(before) and not _part(after):
                if t.weight >= self.limit:
                    strict += 1
                else:
                    soft.add(t)
        return strict, len(soft), sum(t.weight for t in soft)


def _part(char: str) -> bool:
    return char.isascii() and char.isalnum()


_vocabularies: dict[tuple, Vocabulary] = {}


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Iterable[Rule] = RULES,
    terms: Iterable[Term] | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, strict_hits and soft_hits (distinct); `terms` None is the vocabulary of this package."""
    listed = read_terms() if terms is None else tuple(terms)

    @F.pandas_udf("struct<strict_hits:long,soft_hits:long,weight:long>")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if (listed, limit) not in _vocabularies:
            _vocabularies[listed, limit] = Vocabulary(listed, limit)
        own = _vocabularies[listed, limit]
        for urls in parts:
            yield pd.DataFrame([own.hits(u) for u in urls], columns=["strict_hits", "soft_hits", "weight"], dtype="int64")

    url = F.col(url_col)
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    out = (
        pages.select(F.col(id_col), url)
        .select(F.col(id_col), url, after.alias("_after"), counted(url).alias("_hits"))
        .select(
            F.col(id_col),
            F.translate(F.regexp_extract("_after", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
            F.regexp_extract("_after", r"^[^/?#]*([^?#]*)", 1).alias("path"),
            "_hits",
        )
    )
    # The longest rule that fits comes first; its name breaks ties.
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("_hits.strict_hits") >= 1) | (F.col("_hits.weight") >= limit), "block").otherwise("allow")
    for r in reversed(ranked):
        fits = F.concat(F.lit("."), F.col("host")).endswith("." + r.host) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "_hits.strict_hits", "_hits.soft_hits")
