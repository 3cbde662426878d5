"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the words to be taken in proportion to its weight. A source may be read
`max_epochs` times at most: where its share is above that, it is clamped, and the excess is dealt out
to the others by their weights, until none is above. The target of a source is then met by whole
repetitions of all its documents and one fractional repetition, which takes documents in a seeded
random order up to the missing number of words. The document on that border is taken if more of it
lies before the border than behind, so a source misses its target by half a document at most.

Sizes are words between ASCII blanks; null and empty texts have size 0 and are taken 0 times. A null
source is a source of its own, after all others. The random order is that of md5 of the seed and doc_id
(of the text where the id is null); ties go by size, then by a hash of the row, so that reruns agree. Of
rows that are equal in all of these and lie on the border, as many are taken as the target wants. An empty table
gives an empty result. Other columns of the input don't matter and can't clash. Very long texts are one row like any other.

Scale: the sizes are counted once and written as a narrow table. Where a source's repetition ends is found digit by
digit of the order's keys, from sums that every task adds up first, so neither a source with a third of
all rows nor an id with as many meets in one task. One row per source reaches the driver;
documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, packed, small_table, word_count, written

WEIGHTS = (5, 2, 1)
SEED = 7


def by_rank(rank: int, source: str | None) -> float:
    """The default weights repeat over the sources in their order."""
    return WEIGHTS[rank % len(WEIGHTS)]


def water_fill(sizes: list[int], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """The words to take of each source: `total` by weight, no source above `max_epochs` times its size.

    If all sources together can't give `total`, each is clamped.
    """
    caps = [max_epochs * s for s in sizes]
    clamped: set[int] = set()
    while True:
        left = [i for i in range(len(sizes)) if i not in clamped]
        weight = sum(weights[i] for i in left)
        level = (total - sum(caps[i] for i in clamped)) / weight if weight else 0.0
        above = [i for i in left if weights[i] * level > caps[i]]
        if not above:
            return [caps[i] if i in clamped else weights[i] * level for i in range(len(sizes))]
        clamped.update(above)


def _key(seed: int) -> Column:
    """A row's place in the random order, 64 hex digits: md5 of the seed and doc_id (of the text for a null id), the size, and a hash of the row."""
    digits = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.col("text"), F.lit(""))))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), drawn)), digits(word_count(F.col("text"))), digits(F.xxhash64("doc_id", "text")))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"))


PLAN = "p_source string, source_size long, target double, whole long, fraction double, cut string, some long, among long"


def _source_plan(sized: DataFrame, epochs_total: float, max_epochs: float, weight_of: Callable, digits: int, limit: int) -> list[dict]:
    """One row per source: its size, target, whole repetitions, and the end of the fractional one.

    That takes all rows with a key below `cut`, and `some` of the `among` equal rows that have it. The cut is
    found by the digits of the keys: sums of the buckets of the next `digits` digits, in the one bucket
    where the repetition ends, until that has `limit` rows at most or its rows are equal.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    targets = water_fill([r.size for r in totals], [float(weight_of(k, r.source)) for k, r in enumerate(totals)], epochs_total * sum(r.size for r in totals), max_epochs)
    plan = []
    for r, target in zip(totals, targets, strict=True):
        whole = int(target // r.size) if r.size else 0
        plan.append({"p_source": r.source, "source_size": r.size, "target": target, "whole": whole, "fraction": target - r.size * whole, "cut": "", "some": 0, "among": 0})
    by_source = {row["p_source"]: row for row in plan}
    ends = [{"p_source": row["p_source"], "prefix": "", "begin": 0, "fraction": row["fraction"]} for row in plan if row["source_size"]]
    last = []
    for length in range(digits, 64 + digits, digits):
        if not ends:
            break
        state = small_table(spark, ends, "p_source string, prefix string, begin long, fraction double")
        inside = sized.join(state, F.col("source").eqNullSafe(F.col("p_source")) & F.col("key").startswith(F.col("prefix")))
        buckets = inside.groupBy("p_source", "begin", "fraction", F.substring("key", 1, length).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        before = Window.partitionBy("p_source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("begin", F.col("begin") + F.coalesce(F.sum("size").over(before), F.lit(0)))
        found = buckets.where((F.col("begin") <= F.col("fraction")) & (F.col("fraction") < F.col("begin") + F.col("size"))).collect()
        ends = []
        for r in found:
            row = {"p_source": r.p_source, "prefix": r.prefix, "begin": r.begin, "fraction": r.fraction}
            (last if r.n <= limit or length >= 64 else ends).append(row)
    if last:
        state = small_table(spark, last, "p_source string, prefix string, begin long, fraction double")
        inside = sized.join(state, F.col("source").eqNullSafe(F.col("p_source")) & F.col("key").startswith(F.col("prefix")))
        equal = inside.groupBy("p_source", "prefix", "begin", "fraction", "key").agg(F.max("size").alias("size"), F.count("*").alias("n"))
        before = Window.partitionBy("p_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        begin = F.col("begin") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0))
        # A document on the border is taken if more of it lies before the border than behind.
        some = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.try_divide(F.col("fraction") - begin, F.col("size")) + 0.5)))
        cuts = equal.withColumn("some", F.coalesce(some, F.lit(0))).groupBy("p_source", "prefix").agg(F.max(F.when(F.col("some") > 0, F.struct("key", "some", "n"))).alias("cut")).collect()
        for r in cuts:
            # Without a document of its last bucket, the repetition ends before that bucket.
            by_source[r.p_source] |= {"cut": r.prefix, "some": 0, "among": 0} if r.cut is None else {"cut": r.cut.key, "some": r.cut.some, "among": r.cut.n}
    return plan


def _with_repeats(rows: DataFrame, plan: list[dict]) -> DataFrame:
    """`rows` (source, size, key and others) with their source's plan and their `repeats`; no shuffle but of equal rows at a cut."""
    own = small_table(rows.sparkSession, plan, PLAN)
    joined = rows.join(own, F.col("source").eqNullSafe(F.col("p_source")))
    tied = (F.col("key") == F.col("cut")) & (F.col("some") < F.col("among")) & (F.col("size") > 0)
    repeats = F.when(F.col("size") > 0, F.col("whole") + ((F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("some") > 0))).cast("long")).otherwise(F.lit(0).cast("long"))
    if not any(0 < row["some"] < row["among"] for row in plan):
        return joined.withColumn("repeats", repeats)
    # Equal rows are told apart by numbers that stay, as the rows are written with them; each partition is dealt its part.
    numbered = written(joined.where(tied).withColumn("number", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "tied")
    counts = numbered.groupBy("p_source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("p_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("p_source").alias("c_source"), F.col("part").alias("c_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("p_source", "part").orderBy("number"))
    dealt = numbered.withColumn("place", place).join(counts, F.col("p_source").eqNullSafe(F.col("c_source")) & (F.col("part") == F.col("c_part")))
    dealt = dealt.withColumn("repeats", F.col("whole") + (F.col("earlier") + F.col("place") <= F.col("some")).cast("long"))
    return joined.where(~tied).withColumn("repeats", repeats).unionByName(dealt.select(*joined.columns, "repeats"))


def mix_sources(
    docs: DataFrame,
    epochs_total: float = 1.5,
    max_epochs: float = 2.0,
    weight_of: Callable[[int, str | None], float] = by_rank,
    seed: int = SEED,
    digits: int = 3,
    limit: int = 10_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), repeats and taken of every document.

    `weight_of` gets the place of a source in code-point order, null last, and the source.
    """
    sized = written(_sized(docs.select("doc_id", "source", "text"), seed), "sizes")
    out = _with_repeats(sized, _source_plan(sized, epochs_total, max_epochs, weight_of, digits, limit))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def repeat_documents(
    docs: DataFrame,
    epochs_total: float = 1.5,
    max_epochs: float = 2.0,
    weight_of: Callable[[int, str | None], float] = by_rank,
    seed: int = SEED,
    digits: int = 3,
    limit: int = 10_000,
) -> DataFrame:
    """The mix itself: every row of `docs` as often as the mix takes it, all columns kept, whatever their names."""
    sized = written(_sized(docs.select("doc_id", "source", "text"), seed), "sizes")
    plan = _source_plan(sized, epochs_total, max_epochs, weight_of, digits, limit)
    discard(sized)
    rows = docs.select("source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"), packed(docs).alias("row"))
    out = _with_repeats(rows, plan).where("repeats > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")
