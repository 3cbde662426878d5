"""A training-data pipeline over the documents table; each stage's result is written as Parquet and reread.

1. language ID: documents without a language go;
2. line dedup: later occurrences of three-line windows go, and documents that lose all their lines;
3. SimHash near-dedup on five-word shingles: one document of each group stays;
4. mixing: documents are repeated, or left out, to meet the target weights of their sources;
5. byte-level BPE: ids of every text, decoded again.

Every stage takes nulls in any column, empty, blank and very long texts, ties, repeated rows, extra columns of any name and empty tables:

1. null, empty and blank texts and those without a letter have no language and go; a null lang or doc_id is not learnt from;
   repeated rows are judged alike; long texts are parsed whole.
2. null and empty texts stay as they are; of repeated windows the first by doc_id (null last) stays; repeated rows are one document.
3. of repeated rows and of texts without words one stays; rows with a null doc_id are the last choice of a group.
4. rows of a null source are a source of their own; documents without words are left out; of equal rows as many are taken as the target wants.
5. a null text is an empty one, with no ids; repeated rows have a row each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import bpe, langid, lines, mixing, simhash
from veinstone.llm.common import discard, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.predict(docs, model).where("lang_pred <> 'und'").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood before; n_chars is that of what is left."""
    out = lines.dedup_lines(docs).where("lines_removed = 0 OR text RLIKE '[^ \\t\\r\\n]'")
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs, n=5, radius=3).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat_documents(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokenize", tokenize),
]

#: Parsing by automata, fingerprints and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; of what they write in the shared folder only the last result stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch():
            made = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            discard(before)
        docs = before = made
    return docs
