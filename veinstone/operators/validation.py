"""Rules that rows of each kind must meet, as columns: broken rows are set apart with their faults instead of failing a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Text that must not be blank, and numbers with their least and greatest value, by kind of row.
FILLED = {"source": ("title",), "fragment": ("text",), "evidence": ("summary",), "session": ("question",)}
RANGES = {
    "source": {"quality_tier": (0, 3), "citation_count": (0, None)},
    "fragment": {"page_start": (1, None), "page_end": (1, None), "char_count": (0, None)},
    "evidence": {"relevance": (0, 10)},
    "session": {},
}


def _outside(value: Column, low: int | None, high: int | None) -> Column:
    tests = [value < low] * (low is not None) + [value > high] * (high is not None)
    return F.coalesce(tests[0] | tests[-1], F.lit(False))


def faults(rows: DataFrame, kind: str) -> Column:
    """The names of the columns that break a rule, in the order of the rules; numbers may be null, columns may be missing."""
    blank = {c: text.normalize(F.col(c)) == "" for c in FILLED[kind]}
    outside = {c: _outside(F.col(c), *r) for c, r in RANGES[kind].items()}
    found = [F.when(test, F.lit(c)) for c, test in (blank | outside).items() if c in rows.columns]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def split(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The rows that meet all rules, and the others with `faults`."""
    judged = rows.withColumn("faults", faults(rows, kind))
    return judged.where(F.size("faults") == 0).drop("faults"), judged.where(F.size("faults") > 0)


def cleaned(sources: DataFrame) -> DataFrame:
    """Normal forms of the bibliographic columns that are there; what is blank becomes null."""
    empty = F.lit("")
    made = {c: F.nullif(text.normalize(F.col(c)), empty) for c in ("title", "venue", "abstract") if c in sources.columns}
    if "doi" in sources.columns:
        made["doi"] = text.normalize_doi(F.col("doi"))
    if "authors" in sources.columns:
        kept = F.filter(F.transform("authors", text.tidy_space), lambda a: a != "")
        made["authors"] = F.when(F.size(kept) > 0, kept)
    return sources.withColumns(made)
