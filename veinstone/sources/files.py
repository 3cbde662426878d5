"""Corpus files: discovery, decoding, parsers by suffix."""

from __future__ import annotations

import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity

SUFFIXES = (".pdf", ".txt", ".md", ".markdown", ".text")
# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5", "utf-16")
BAD_SHARE, LOOKED_AT = 0.02, 4000

PAGES = "array<struct<page_number:int,text:string>>"
PARSED = f"struct<pages:{PAGES},parser:string,error:string>"


def discover(spark: SparkSession, roots: list[str], max_mb: float = 50.0, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """rel_path, path, length, modified, content of the files below the roots (or roots that are files).

    Hidden files and folders, other suffixes and files over `max_mb` are skipped; a missing root gives
    nothing. rel_path begins with the name of its root.
    """
    found = None
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            continue
        own = fs.makeQualified(path).toUri().getPath().rstrip("/")
        base = own.rsplit("/", 1)[0]
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        bare = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
        rel = F.url_decode(F.replace(F.substring(bare, len(base) + 2, 10_000), F.lit("+"), F.lit("%2B")))
        part = rows.select(rel.alias("rel_path"), "path", "length", F.col("modificationTime").alias("modified"), "content")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "rel_path string, path string, length long, modified timestamp, content binary")
    known = F.lit(False)
    for s in suffixes:
        known = known | F.lower("rel_path").endswith(s)
    return found.where(~F.col("rel_path").rlike(r"(^|/)\.") & known & (F.col("length") <= int(max_mb * 1024 * 1024)))


# Folders that hold no source of their own.
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build", "site-packages", "target")


def source_tree(spark: SparkSession, roots: list[str], max_mb: float = 5.0, suffixes: tuple[str, ...] = ("",)) -> DataFrame:
    """rel_path, suffix, text of the text files below the roots: not hidden, not in folders of built or foreign files, not too large, without NUL."""
    found = discover(spark, roots, max_mb, suffixes).where(~F.col("rel_path").rlike("(^|/)(" + "|".join(SKIPPED) + ")/"))
    plain = ~F.contains(F.substring("content", 1, 8192), F.lit(b"\0"))
    suffix = F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1))
    return found.where(plain).select("rel_path", suffix.alias("suffix"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def content_hash(content: Column) -> Column:
    return identity.digest(content)


def decode(data: bytes) -> str:
    """Text of unknown encoding: the first that decodes strictly and isn't full of odd characters, else UTF-8 with replacements."""
    for encoding in ENCODINGS:
        try:
            text = data.decode(encoding)
        except (UnicodeDecodeError, UnicodeError):
            continue
        head = text[:LOOKED_AT]
        odd = sum(c in "\ufffd\0" or "\ue000" <= c <= "\uf8ff" for c in head)
        if odd <= BAD_SHARE * len(head):
            return text
    return data.decode("utf-8", "replace")


def parse_text(data: bytes) -> list[tuple[int, str]]:
    """Pages between form feeds."""
    return [(k, page) for k, page in enumerate(decode(data).split("\f"), start=1)]


def parse_pdf(data: bytes) -> list[tuple[int, str]]:
    """Text by page; pages that fail are left out, and a file without a text layer is an error."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted and not reader.decrypt(""):
        raise ValueError("encrypted")
    pages = []
    for k, page in enumerate(reader.pages, start=1):
        try:
            pages.append((k, page.extract_text() or ""))
        except Exception:  # noqa: BLE001, S112 - one bad page doesn't lose the others
            continue
    if sum(len(t) for _, t in pages) < 20 * max(1, len(pages)):
        raise ValueError("no text layer")
    return pages


Parser = Callable[[bytes], list[tuple[int, str]]]
_parsers: dict[str, tuple[str, Parser]] = {s: ("text", parse_text) for s in (".txt", ".md", ".markdown", ".text")} | {".pdf": ("pdf", parse_pdf)}


def register_parser(suffix: str, name: str, parser: Parser) -> None:
    """A parser for another suffix, or in place of the one it has."""
    _parsers[suffix.lower()] = (name, parser)


def parsed(files: DataFrame) -> DataFrame:
    """`files` with `parsed`: pages, parser and error. A file that can't be parsed never fails the task."""
    own = dict(_parsers)

    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for name, data in zip(names, contents, strict=True):
            suffix = "." + name.rsplit(".", 1)[-1].lower()
            kind, parser = own.get(suffix, (None, None))
            if parser is None:
                rows.append((None, None, f"no parser for {suffix}"))
                continue
            try:
                rows.append(([{"page_number": n, "text": t} for n, t in parser(bytes(data))], kind, None))
            except Exception as error:  # noqa: BLE001 - recorded with the file
                rows.append((None, kind, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["pages", "parser", "error"])

    return files.withColumn("parsed", F.pandas_udf(run, PARSED)("rel_path", "content"))
