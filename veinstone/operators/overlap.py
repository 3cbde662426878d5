"""Overlap between a target and a reference corpus: n-grams, lines, blocks, strings, whole texts.

N-grams travel as 64-bit hashes, distinct per document before the shuffle, and only those of the
reference side's set come back: a semi-join, so no pair of documents is formed for a common n-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import state

# The lengths of runs that are looked for, longest first.
LADDER = (100, 60, 40, 25)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of a token array, as hashes."""
    count = F.size(tokens) - (n - 1)
    return F.array_distinct(F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(n)))))


def ngram_rows(docs: DataFrame, id_col: str, tokens: Column, n: int) -> DataFrame:
    """id, gram: the distinct n-grams of each document."""
    # Outer, as otherwise a filter on the array would be pushed down, and n-grams be made twice.
    return docs.select(F.col(id_col).alias("id"), tokens.alias("_t")).select("id", F.explode_outer(ngrams(F.col("_t"), n)).alias("gram")).where("gram IS NOT NULL")


def containment(target: DataFrame, reference: DataFrame, small: int = 300) -> DataFrame:
    """id, total, shared, containment, exempt of each target document that shares an n-gram (id, gram)."""
    pool = reference.select(F.col("gram").alias("r")).distinct()
    total = target.groupBy("id").agg(F.count("*").alias("total"))
    shared = target.join(pool, F.col("gram") == F.col("r"), "left_semi").groupBy("id").agg(F.count("*").alias("shared")).withColumnRenamed("id", "s")
    return total.join(shared, F.col("id") == F.col("s")).select("id", "total", "shared", F.round(F.col("shared") / F.col("total"), 6).alias("containment"), (F.col("total") < small).alias("exempt"))


def jaccard(target: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: sizes of both pools of distinct n-grams, of what they share, containment and Jaccard."""
    t, r = (x.select("gram").distinct() for x in (target, reference))
    both = t.withColumn("a", F.lit(1)).unionByName(r.withColumn("a", F.lit(2))).groupBy("gram").agg(F.sum("a").alias("a"))
    sizes = both.agg(F.count_if(F.col("a") != 2).alias("target"), F.count_if(F.col("a") != 1).alias("reference"), F.count_if(F.col("a") == 3).alias("shared"))
    return sizes.withColumn("containment", F.round(F.try_divide("shared", "target"), 6)).withColumn("jaccard", F.round(F.try_divide(F.col("shared"), F.col("target") + F.col("reference") - F.col("shared")), 6))


def longest_rung(target: DataFrame, reference: DataFrame, id_cols: tuple[str, str], tokens: Column, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """id, run: the longest rung of the ladder at which a target document shares a run of tokens."""
    found = None
    for n in ladder:
        pool = ngram_rows(reference, id_cols[1], tokens, n).select(F.col("gram").alias("r")).distinct()
        rung = ngram_rows(target, id_cols[0], tokens, n).join(pool, F.col("gram") == F.col("r"), "left_semi").select("id").distinct().withColumn("run", F.lit(n))
        found = rung if found is None else found.unionByName(rung)
    return found.groupBy("id").agg(F.max("run").alias("run"))


def line_rows(docs: DataFrame, id_col: str, least: int = 12) -> DataFrame:
    """id, line_no (from 1), line: trimmed lines of `least` characters and more."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split("text", "\n")).alias("k", "line")).select("id", (F.col("k") + 1).alias("line_no"), F.btrim("line").alias("line"))
    return rows.where(F.length("line") >= least)


def line_copies(target: DataFrame, reference: DataFrame) -> DataFrame:
    """id, line_no, ref_id, ref_line of lines (id, line_no, line) that also stand in the reference."""
    r = reference.select(F.col("id").alias("ref_id"), F.col("line_no").alias("ref_line"), F.col("line").alias("r"))
    return target.join(r, F.col("line") == F.col("r")).select("id", "line_no", "ref_id", "ref_line", "line")


def aligned_blocks(copies: DataFrame, least: int = 2) -> DataFrame:
    """id, ref_id, length and first lines of runs of copied lines that go on in both texts."""
    return state.islands(copies, ("id", "ref_id"), "line_no", "ref_line", least)


def common_tokens(docs: DataFrame, id_col: str, tokens: Column, share: float = 0.1) -> DataFrame:
    """term, df: tokens of at least `share` of the documents (and of one)."""
    n = docs.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share)).alias("least"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), F.col("df") >= F.col("least")).select("term", "df")


def nearest_string(target: DataFrame, reference: DataFrame, band: int = 10, most: int = 12) -> DataFrame:
    """id, ref_id, distance: the nearest reference string (id, s) of each target string by edit distance, `most` and less.

    Lengths may differ by `band`; both sides meet in buckets of lengths, a target in its own and the next ones.
    Distinct strings meet; their rows take the result over afterwards.
    """
    t = target.select("s").distinct().withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.length("s") / band) + o)))
    r = reference.groupBy(F.col("s").alias("r")).agg(F.min("id").alias("ref_id")).withColumn("_rb", F.floor(F.length("r") / band))
    pairs = t.join(r, (F.col("_b") == F.col("_rb")) & (F.abs(F.length("s") - F.length("r")) <= band)).withColumn("distance", F.levenshtein("s", "r", most)).where("distance >= 0")
    best = pairs.groupBy("s").agg(F.min(F.struct("distance", "ref_id")).alias("best"))
    return target.join(best, "s").select("id", "best.ref_id", "best.distance")


def exact_copies(target: DataFrame, reference: DataFrame) -> DataFrame:
    """id, ref_id of equal, non-empty contents (id, text); a target pairs with the first such reference."""
    key = F.sha2("text", 256)
    r = reference.where("length(text) > 0").groupBy(key.alias("r")).agg(F.min("id").alias("ref_id"))
    return target.where("length(text) > 0").withColumn("h", key).join(r, F.col("h") == F.col("r")).select("id", "ref_id")


#: Lines that bring in other modules or start a program.
BOILERPLATE = (r"^import [A-Za-z_][\w.]*( as \w+)?(, *[A-Za-z_][\w.]*( as \w+)?)*$", r"^from [.\w]+ import [\w*(]", r"^if __name__ ?== ?")
#: Lines that any program has: bare keywords, and what is left of a line without its brackets, commas and colons.
KEYWORDS = ("else", "try", "finally", "pass", "break", "continue", "return", "do", "end", "begin", "default")
BRACKETS = "()[]{},:;"


def line_tier(line: Column, common: Column) -> Column:
    """boilerplate, generic (only brackets, one bare keyword or name, or only common words) or substantive."""
    begins = F.lit(False)
    for form in BOILERPLATE:
        begins = begins | line.rlike(form)
    bare = F.trim(F.translate(line, BRACKETS, ""))
    words = F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    distinct = F.exists(words, lambda w: ~F.array_contains(common, w))
    return F.when(begins, "boilerplate").when((bare == "") | bare.isin(*KEYWORDS) | ~distinct, "generic").otherwise("substantive")
