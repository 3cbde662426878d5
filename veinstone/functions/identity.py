"""Keys derived from contents, so that a rebuild gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_doi

UNIT = "\x1f"


def digest(value: Column, length: int = 16) -> Column:
    """The first hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, length)


def derive_key(*parts: Column, prefix: str = "", length: int = 16) -> Column:
    """Of parts in their canonical form; a separator keeps ab, c apart from a, bc."""
    return F.concat(F.lit(prefix), digest(F.concat_ws(UNIT, *parts), length))


def source_key(doi: Column, content_hash: Column) -> Column:
    """By DOI if there is one, else by content."""
    clean = normalize_doi(doi)
    return digest(F.when(clean.isNotNull(), F.concat(F.lit("doi:"), clean)).otherwise(F.concat(F.lit("hash:"), content_hash)))


def fragment_id(source: Column, document_hash: Column, section_path: Column, chunk_index: Column) -> Column:
    return derive_key(source, document_hash, F.array_join(section_path, "/"), chunk_index.cast("string"))


def evidence_key(source: Column, fragment: Column) -> Column:
    return F.concat(F.lit("ev-"), digest(F.concat_ws(":", source, fragment), 8))
