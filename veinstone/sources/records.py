"""Line records and small tables: JSON lines with last write, evaluation cases, retraction lists; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_doi

CASE = "question string, expected_answerable boolean, expected_keywords array<string>, forbidden_keywords array<string>, id string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a declared schema; broken lines are skipped."""
    rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken IS NULL").drop("_broken")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Records are only added; readers take the last of a key."""
    rows.write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; comments, blank and broken lines, and lines without a question are skipped."""
    lines = spark.read.text(path).where(~F.btrim("value").startswith("#") & (F.btrim("value") != ""))
    made = lines.select(F.from_json("value", CASE).alias("c")).select("c.*").where("question IS NOT NULL")
    none = F.array().cast("array<string>")
    return made.select("question", F.coalesce("expected_answerable", F.lit(True)).alias("expected_answerable"), F.coalesce("expected_keywords", none).alias("expected_keywords"), F.coalesce("forbidden_keywords", none).alias("forbidden_keywords"), "id")


def read_retractions(spark: SparkSession, path: str, names: tuple[str, ...] = ("doi", "originalpaperdoi", "original_doi", "paper_doi")) -> DataFrame:
    """doi of a CSV file with a column of one of these names (case doesn't count); none without such a column or file."""
    empty = spark.createDataFrame([], "doi string")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        return empty
    rows = spark.read.option("header", "true").csv(path)
    columns = {c.strip().lstrip("﻿").lower(): c for c in rows.columns}
    column = next((columns[n] for n in names if n in columns), None)
    return empty if column is None else rows.select(normalize_doi(F.col(f"`{column}`")).alias("doi")).where("doi IS NOT NULL").distinct()


def markdown_table(rows: DataFrame, limit: int = 200) -> str:
    """A report's table from a small result; for aggregates, not for data."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows.limit(limit).collect())])
