"""Evidence: screening, budgets, context, citation binding, and the status of a session."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations, text
from .state import COUNTERS

# Why a session is cut short.
TRUNCATED = ("timeout", "budget_exceeded", "max_steps_exceeded", "no_new_evidence")


def in_years(sources: DataFrame, low: int | None, high: int | None, year: str = "year") -> DataFrame:
    """Sources of a range of years; those without a year stay."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(year) >= low)
    if high is not None:
        inside = inside & (F.col(year) <= high)
    return sources.where(F.col(year).isNull() | inside)


def screened(judged: DataFrame, k: int, by: str, min_relevance: int = 5) -> DataFrame:
    """The k most relevant of each group that are relevant at all, ties by key."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("relevance"), "key"))
    return judged.where(F.col("relevance") >= min_relevance).withColumn("rank", place).where(F.col("rank") <= k)


def budgeted(judged: DataFrame, n: int | None, by: str, seq: str) -> DataFrame:
    """The first n by relevance in stable order; None keeps all."""
    ranked = judged.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("relevance"), seq)))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def rank_relevance(rank: Column, n: Column, least: int) -> Column:
    """A relevance from a rank, linear from 10 down; halves to even."""
    return F.greatest(F.lit(least), F.bround(10 * (n - rank + 1) / n).cast("int"))


def context(ranked: DataFrame, entry: Column, by: str) -> DataFrame:
    """The entries of each group in order of rank, a blank line between them."""
    rows = F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return ranked.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["entry"]), "\n\n").alias("context"))


def cited(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (source_key, label) with an inline citation; a missing source is unknown."""
    return rows.join(sources, "source_key", "left").withColumn("citation", citations.inline(F.coalesce("stem", F.lit("unknown")), F.col("label")))


def citation_counts(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, valid and dangling keys of each answer (answer_id, raw)."""
    keys = answers.select("answer_id", F.explode_outer(text.evidence_keys(F.col("raw"))).alias("k"))
    known = evidence.select(F.col("key").alias("known"))
    return keys.join(known, F.col("k") == F.col("known"), "left").groupBy("answer_id").agg(F.count("known").alias("valid"), F.count_if(F.col("k").isNotNull() & F.col("known").isNull()).alias("dangling"))


#: What binding looks at; the form of a key is a fixed value.
_TOKEN = re.compile(r"\bev-[0-9a-f]{8}\b|[()\[\]]")
#: Marks that no blank stands before.
_CLOSE_UP = frozenset(",.;:!?，。；：！？")


def bind(raw: str, inline: dict[str, str]) -> str:
    """An answer with its evidence keys replaced by citations; keys without evidence go, and groups of only such.

    One scan over keys and brackets gives the spans to replace: a pair of parentheses with keys and no
    other pair in it, a key in square brackets, and any other key.
    """
    marks = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(raw)]
    spans: list[tuple[int, int, list[str]]] = []
    opened: tuple[int, int] | None = None  # where a parenthesis begins, and how many spans there were
    for k, (mark, begin, end) in enumerate(marks):
        if mark == "(":
            opened = begin, len(spans)
        elif mark == ")":
            if opened and len(spans) > opened[1]:
                spans[opened[1] :] = [(opened[0], end, list(dict.fromkeys(key for *_, keys in spans[opened[1] :] for key in keys)))]
            opened = None
        elif mark not in "[]":
            around = [marks[j] for j in (k - 1, k + 1) if 0 <= j < len(marks)]
            if len(around) == 2 and (around[0][0], around[0][2], around[1][0], around[1][1]) == ("[", begin, "]", end):
                begin, end = begin - 1, end + 1
            spans.append((begin, end, [mark]))
    out, at = [], 0
    for begin, end, keys in spans:
        known = ", ".join(inline[key] for key in keys if key in inline)
        out += [raw[at:begin], f"({known})" if known else ""]
        at = end
    return tidy("".join(out) + raw[at:])


def tidy(text: str) -> str:
    """Without empty parentheses, blanks in a row or before closing marks, and more than one empty line."""
    while (begin := next((m.start() for m in re.finditer(r"\(", text) if text[m.end() :].lstrip().startswith(")")), None)) is not None:
        text = text[:begin] + text[text.index(")", begin) + 1 :]
    parts = re.split(r"([ \t]+|\n+)", text)
    made = []
    for part, following in zip(parts, [*parts[1:], ""], strict=True):
        if part and part[0] in " \t":
            close = following[:1] in _CLOSE_UP and following != ""
            made.append("" if close else part if len(part) == 1 else " ")
        else:
            made.append("\n\n" if part.startswith("\n\n\n") else part)
    return "".join(made).strip()


def bound(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, text, keys (known, in first use), refused, uncited of answers (answer_id, raw).

    Only the evidence that an answer names is joined to it, so no answer carries a whole evidence table.
    """
    refusal = text.is_refusal(F.col("raw"))
    named = answers.select("answer_id", F.posexplode(text.evidence_keys(F.col("raw"))).alias("place", "key"))
    own = named.join(evidence.select("key", "inline"), "key").groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("place", "key", "inline"))).alias("used"))

    def replaced(raws: pd.Series, used: pd.Series) -> pd.Series:
        return pd.Series([bind(r, {u["key"]: u["inline"] for u in (own if own is not None else [])}) for r, own in zip(raws, used, strict=True)])

    joined = answers.join(own, "answer_id", "left").withColumn("refusal", refusal)
    made = F.pandas_udf(replaced, "string")(F.col("raw"), F.col("used"))
    keys = F.coalesce(F.array_join(F.transform("used", lambda u: u["key"]), ","), F.lit(""))
    return joined.select(
        "answer_id",
        F.when(F.col("refusal"), text.strip(F.col("raw"))).otherwise(made).alias("text"),
        F.when(F.col("refusal"), "").otherwise(keys).alias("keys"),
        (F.col("refusal") | F.col("used").isNull()).alias("refused"),
        (~F.col("refusal") & F.col("used").isNull()).alias("uncited"),
    )


def budget(usage: DataFrame, max_tokens: int | None, max_cost: float | None) -> DataFrame:
    """Usage with `exceeded`: tokens, cost or null. An unknown cost can't exceed."""
    total = F.col(COUNTERS[0]) + F.col(COUNTERS[1])
    tokens = F.lit(False) if max_tokens is None else total > max_tokens
    costs = F.lit(False) if max_cost is None else F.col("cost_known") & (F.col("estimated_cost") > max_cost + 1e-9)
    return usage.withColumn("exceeded", F.when(tokens, "tokens").when(costs, "cost"))


def status(notes: Column, answered: Column, refused: Column, uncited: Column, fallback: str) -> Column:
    """Failure before missing citations before truncation before what the agent said before refusal."""
    ended = F.exists(notes, lambda n: n.startswith("finish:"))
    return (
        F.when(F.array_contains(notes, "synthesis_failed"), "FAIL")
        .when(answered & uncited, "UNCITED")
        .when(F.arrays_overlap(notes, F.array(*map(F.lit, TRUNCATED))), "TRUNCATED")
        .when(ended & answered & ~refused, "SUCCESS")
        .when(ended, "UNSURE")
        .when(answered & refused, "REFUSED")
        .otherwise(fallback)
    )


def compacted(messages: DataFrame, limit: int, role: str = "tool", head: int = 2, tail: int = 4, chars: int = 200) -> DataFrame:
    """Histories over `limit` tokens with their old, long observations cut to the first line; no message goes."""
    w = Window.partitionBy("conv_id")
    made = messages.withColumn("_k", F.row_number().over(w.orderBy("turn")) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_total", F.sum(text.estimate_tokens(F.col("text"))).over(w))
    old = (F.col("_total") > limit) & (F.col("_k") >= head) & (F.col("_k") < F.greatest(F.lit(head), F.col("_n") - tail))
    short = F.concat(F.lit(f"{role} (compacted): "), text.first_line(F.col("text"), chars))
    return made.withColumn("text", F.when(old & (F.col("role") == role) & (F.length("text") > chars), short).otherwise(F.col("text"))).drop("_k", "_n", "_total")


def provided(fields: dict[str, Column]) -> Column:
    """The names of the fields that have a value."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), name) for name, c in fields.items()]))
