"""An audit of one collection of texts against another: shared n-grams, blocks, lines, strings and whole texts, each with a verdict."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, overlap
from ..sources import files


class Limits(NamedTuple):
    """What is still let pass: the share of a text's n-grams, the length of a copied block, copied lines and whole texts."""

    ngram: int = 8
    containment: float = 0.05
    block: int = 4
    lines: int = 0
    assets: int = 0


def checks(target: DataFrame, reference: DataFrame, limits: Limits = Limits(), substantive: bool = False) -> DataFrame:
    """name, found and failed of each check of target against reference texts (id, text).

    With `substantive` only lines count that say something: not imports, brackets, bare keywords or words of a tenth of all texts.
    """
    tokens = text.tokens(F.col("text"))
    contained = overlap.containment(overlap.ngram_rows(target, "id", tokens, limits.ngram), overlap.ngram_rows(reference, "id", tokens, limits.ngram))
    copies = overlap.line_copies(overlap.line_rows(target, "id"), overlap.line_rows(reference, "id"))
    if substantive:
        common = overlap.common_tokens(target, "id", tokens).agg(F.collect_list("term").alias("common"))
        copies = copies.join(F.broadcast(common)).where(overlap.line_tier(F.col("line"), F.col("common")) == "substantive").drop("common")
    blocks = overlap.aligned_blocks(copies, 1).agg(F.coalesce(F.max("length"), F.lit(0)).alias("found"))
    assets = overlap.exact_copies(target.select("id", "text"), reference.select("id", "text"))
    row = lambda name, df, failed: df.select(F.lit(name).alias("name"), "found", failed.alias("failed"))
    return (
        contained.agg(F.count("*").alias("found"), F.count_if(~F.col("exempt") & (F.col("containment") > limits.containment)).alias("bad")).select(F.lit("ngrams").alias("name"), "found", (F.col("bad") > 0).alias("failed"))
        .unionByName(row("blocks", blocks, F.col("found") > limits.block))
        .unionByName(row("lines", copies.agg(F.count("*").alias("found")), F.col("found") > limits.lines))
        .unionByName(row("assets", assets.agg(F.count("*").alias("found")), F.col("found") > limits.assets))
    )


def trees(spark: SparkSession, target: list[str], reference: list[str], limits: Limits = Limits(), listed: int = 20) -> dict:
    """The checks of two source trees, with the strings nearest to the reference's, worst first; `passed` if none failed."""
    own, other = (files.source_tree(spark, roots) for roots in (target, reference))
    rows = checks(*(t.select(F.col("rel_path").alias("id"), "text") for t in (own, other)), limits, substantive=True).collect()
    near = audit.nearest_strings(*(audit.literal_rows(t).select(F.col("literal").alias("s")) for t in (own, other)))
    worst = [r.asDict() for r in audit.worst_first(near, listed).collect()]
    strings = sum(r["violation"] for r in worst)
    found = [*(r.asDict() for r in rows), {"name": "strings", "found": strings, "failed": strings > 0}]
    return {"passed": not any(r["failed"] for r in found), "checks": found, "strings": worst}
