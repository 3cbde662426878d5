"""Line dedup by overlapping windows of consecutive lines.

The lines of a text are numbered; blank lines are stepped over. Every `window` consecutive lines (blanks
at their ends trimmed) make a window. Of a window that occurs more than once anywhere, the first
occurrence stays, in the order of doc_id (null last), text hash and line; the lines of all later ones
are covered, overlapping ones merge, and covered lines are removed with the blank lines between them.

Null texts stay null; texts with fewer lines than a window stay whole, and so do empty ones. Repeated
rows with one doc_id and text are one document: they lose the same lines. Documents that lose every
line keep an empty text. Other columns stay as they are, whatever their names. An empty table gives an empty result.

Scale: only a hash of each window is shuffled (96 bits, so that 10**12 windows have hardly a chance
collision), pre-aggregated to its first occurrence, and only later occurrences are joined back. A very
common window is a skewed key of that join on its long side only, which adaptive execution splits.
Texts are shuffled once, to meet their covered lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches, written

BLANKS = " \t\r"
KEY = ("_doc_null", "doc_id", "_text")


def windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """One row per window: the document's key, `at` (its number among the document's windows) and hashes h1, h2."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    hashed = docs.select(*KEY, F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"))).alias("_lines")).where(F.size("_lines") >= window)
    parts = [F.slice("_lines", F.lit(k + 1), F.size("_lines") - (window - 1)) for k in range(window)]
    each = hashed.select(*KEY, F.posexplode(F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)])).alias("at", "w"))
    names = [f"w.`w{k}`" for k in range(window)]
    return each.select(*KEY, "at", F.xxhash64(*[F.col(f"{n}.a") for n in names]).alias("h1"), F.hash(*[F.col(f"{n}.b") for n in names]).alias("h2"))


def repeated_windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """The document's key and `covered`, the numbers of its windows that occurred before."""
    every = written(windows(docs, window), "windows")
    place = F.struct(*KEY, "at")
    first = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first")
    later = every.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where(place > F.col("first"))
    # Repeated rows would give each number twice.
    return later.groupBy(*KEY).agg(F.collect_set("at").alias("covered"))


def cut_lines(text: str, covered: np.ndarray, window: int) -> tuple[str, int]:
    """The text without the lines of the covered windows, and how many lines (blank ones apart) went."""
    lines = text.split("\n")
    full = np.array([k for k, line in enumerate(lines) if line.strip(BLANKS)], dtype=np.int64)
    ends = np.zeros(len(full) + 1, np.int64)
    np.add.at(ends, covered, 1)
    np.add.at(ends, np.minimum(covered + window, len(full)), -1)
    gone_full = np.cumsum(ends[:-1]) > 0
    gone = np.zeros(len(lines), bool)
    gone[full[gone_full]] = True
    for k in np.flatnonzero(gone_full[:-1] & gone_full[1:]):
        gone[full[k] : full[k + 1]] = True
    return "\n".join(line for line, out in zip(lines, gone, strict=True) if not out), int(gone_full.sum())


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """Every row of `docs` with its shortened text; all columns stay, and lines_removed long is added
    (in place of an input column of that name)."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<text:string,gone:long>")
    def shortened(texts: pd.Series, covered: pd.Series) -> pd.DataFrame:
        made = [(None, 0) if t is None else cut_lines(t, np.asarray(c, dtype=np.int64), window) for t, c in zip(texts, covered, strict=True)]
        return pd.DataFrame(made, columns=["text", "gone"])

    keyed = docs.select("doc_id", "text", packed(docs).alias("row")).withColumn("_doc_null", F.col("doc_id").isNull()).withColumn("_text", F.xxhash64("text"))
    covered = repeated_windows(keyed.select(*KEY, "text"), window).select(F.col("doc_id").alias("c_doc"), F.col("_text").alias("c_text"), "covered")
    met = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("_text") == F.col("c_text")), "left")
    hit = F.col("covered").isNotNull()
    # Only texts that lose lines go to Python.
    cut = shortened(F.when(hit, F.col("text")), F.coalesce("covered", F.array().cast("array<int>")))
    made = met.select("row", cut.alias("cut"), hit.alias("hit"))
    field = lambda c: F.col(f"row.`{c}`")
    kept = [F.when(F.col("hit"), F.col("cut.text")).otherwise(field(c)).alias(c) if c == "text" else field(c).alias(c) for c in docs.columns if c != "lines_removed"]
    return made.select(*kept, F.when(F.col("hit"), F.col("cut.gone")).otherwise(F.lit(0).cast("long")).alias("lines_removed"))
