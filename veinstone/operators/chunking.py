"""Documents to fragments: a partition-wise walk over documents, which no relational plan expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, structure
from ..functions.structure import Chunking
from ..session import released, small_batches

FRAGMENT = "source_key string, document_hash string, chunk_index int, text string, section_path array<string>, page_start int, page_end int, char_count int"


def fragments(docs: DataFrame, chunking: Chunking = Chunking(), walk_pages: Callable = structure.chunks, guarded: bool = False, every: bool = False) -> DataFrame:
    """fragment_id and FRAGMENT columns of documents (source_key, document_hash, pages: array<struct<page_number, text>>).

    Each document is walked in one task; nothing is shuffled. An empty document, or one of headings alone, gives no row; with
    `every` it gives one without a fragment. `walk_pages` makes the units of a document's pages. With `guarded` there is a column `error` too: a document that fails is one
    row with it and without a fragment, and the others go on.
    """
    chunking.checked()
    small_batches(docs.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, digest, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    made = walk_pages([(p["page_number"], p["text"] or "") for p in pages or []], chunking)
                    rows += [(key, digest, k, u.text, list(u.path), u.first, u.last, len(u.text), None) for k, u in enumerate(made)]
                    if every and not made:
                        rows.append((key, digest, *[None] * 7))
                except Exception as error:  # noqa: BLE001 - recorded with the document
                    if not guarded:
                        raise
                    rows.append((key, digest, *[None] * 6, f"{type(error).__name__}: {error}"))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    schema = f"{FRAGMENT}, error string"
    made = docs.select("source_key", "document_hash", "pages").mapInArrow(released(walk), schema)
    named = F.when(F.col("chunk_index").isNotNull(), identity.fragment_id(F.col("source_key"), F.col("document_hash"), F.col("section_path"), F.col("chunk_index")))
    made = made.select(named.alias("fragment_id"), "*")
    return made if guarded else made.drop("error")


def pages(text: Column) -> Column:
    """A text's pages, cut at form feeds and numbered from 1."""
    return F.transform(F.split(text, "\f"), lambda t, k: F.struct((k + 1).alias("page_number"), t.alias("text")))


def _split(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: structure.sentences(t or ""))


def sentences(text: Column) -> Column:
    return F.pandas_udf(_split, "array<string>")(text)


def _stripped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "\n".join(line for line, _ in structure.without_references([(x, 0) for x in (t or "").splitlines()])))


def strip_references(text: Column) -> Column:
    """A text without its lists of references."""
    return F.pandas_udf(_stripped, "string")(text)


def hard_split(text: Column, most: int = 3000, overlap: int = 200) -> Column:
    """Windows of `most` characters that overlap; a short text is one."""
    step = max(1, most - overlap)
    starts = F.when(F.length(text) <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(most)))


def pack(parts: Column, target: int) -> Column:
    """Paragraphs in order, joined by a blank line while they fit into `target` characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(state: Column, part: Column) -> Column:
        fits = (state["held"] != "") & (F.length(state["held"]) + F.length(part) + 2 <= target)
        first = state["held"] == ""
        return F.struct(
            F.when(first | fits, state["done"]).otherwise(F.array_append(state["done"], state["held"])).alias("done"),
            F.when(first, part).when(fits, F.concat(state["held"], F.lit("\n\n"), part)).otherwise(part).alias("held"),
        )

    return F.aggregate(parts, empty, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.array_append(s["done"], s["held"])))
