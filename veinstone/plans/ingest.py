"""Building an index: files to sources, fragments, vectors and terms, incrementally by content hash."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity, stem, structure, text
from ..operators import chunking, enrichment, lexical, postings, state, validation
from ..operators.postings import Postings
from ..session import released, small_batches
from ..sources import files
from ..sources.segments import Change, Segments
from .settings import Settings

MANIFEST = "rel_path string, hash string, source_key string, status string, error string, fragment_count long"
FRAGMENTS = f"fragment_id string, {chunking.FRAGMENT}"
SOURCES = "source_key string, content_hash string, rel_path string, title string, doi string, authors array<string>, year int, venue string, metadata_complete boolean"
VECTORS = "fragment_id string, source_key string, embedding array<double>"
TERMS = "fragment_id string, source_key string, tokens array<string>, length int, stems array<string>, stem_length int"


#: Tables whose rows belong to a source; full-text fields and the column of `terms` that each is made of.
TABLES = ("fragments", "sources", "vectors", "terms")
FIELDS = {"words": "tokens", "english": "stems"}
#: Failed files and duplicate sources that a report lists.
LISTED = 100


class Report(NamedTuple):
    """What a build did, and the version that it made current; the lists are sorted and have LISTED entries at most."""

    version: str
    actions: dict[str, int]
    failed: int
    fragments: int
    duplicate_sources: int
    failures: list[tuple[str, str]] = []
    duplicates: list[tuple[str, list[str]]] = []

    @property
    def ok(self) -> bool:
        return not self.failed or bool(self.fragments)


def described(parsed: DataFrame) -> DataFrame:
    """Parsed files with DOI, title and keys: a printed DOI, else one made of an arXiv id."""
    name = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.[^.]*$", "")
    # Each step is a column of its own, so that none is worked out for every use.
    made = parsed.withColumn("_head", F.substring(F.get(F.col("parsed.pages.text"), F.lit(0)), 1, 4000))
    made = made.withColumn("_doi", text.normalize_doi(text.find_doi(F.col("_head")))).withColumn("_arxiv", text.find_arxiv(F.col("_head")))
    made = made.withColumn("doi", F.coalesce("_doi", F.lower(F.concat(F.lit("10.48550/arXiv."), "_arxiv"))))
    made = made.withColumn("_line", F.get(F.filter(F.transform(text.lines(F.col("_head")), text.strip), lambda x: x != ""), F.lit(0)))
    made = made.withColumn("_heading", text.heading(F.col("_line"), F.lit(False))["title"]).withColumn("_plain", text.normalize(F.col("_heading")))
    # A heading that is a placeholder, or the file's own name, says nothing.
    made = made.withColumn("_odd", (F.col("_plain") == "") | text.is_placeholder_title(F.col("_plain"), name))
    made = made.withColumn("title", F.when(F.col("_odd"), name).otherwise(F.col("_plain"))).drop("_head", "_doi", "_arxiv", "_line", "_heading", "_plain", "_odd")
    return made.withColumn("source_key", identity.source_key(F.col("doi"), F.col("hash")))


#: Makes a row of numbers for each of a batch of texts; called on the executors.
Embedder = Callable[[list[str]], np.ndarray]


class Hashed(NamedTuple):
    """The offline stand-in for an embedding model: (code mod 97) / 97 of each character, summed by its place modulo `dims`."""

    dims: int

    def __call__(self, texts: list[str]) -> np.ndarray:
        made = np.zeros((len(texts), self.dims))
        for k, value in enumerate(texts):
            codes = np.frombuffer(value.encode("utf-32-le", "replace"), np.uint32) % 97 / 97
            made[k] = np.bincount(np.arange(len(codes)) % self.dims, codes, self.dims)
        return made


def unit_vectors(texts: list[str], model: Embedder, dims: int) -> np.ndarray:
    """A vector of unit length for each text; one that is zero stays so."""
    made = np.asarray(model(texts), np.float64).reshape(len(texts), -1)
    if made.shape[1] != dims or not np.isfinite(made).all():
        raise ValueError(f"vectors of {made.shape[1]} numbers, {dims} wanted, all finite")
    length = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return made / np.where(length > 0, length, 1)


def embedded(rows: DataFrame, dims: int, keys: tuple[str, ...] = ("fragment_id", "source_key"), column: str = "text", embedder: Embedder | None = None, guarded: bool = False) -> DataFrame:
    """Key columns and `embedding`: whole texts embedded in batches, of unit length; vectors stay apart from the fragments.

    With `guarded` there is a column `error` too: if a batch fails, its texts are embedded one by one, and those that fail have it.
    """
    vectors = functools.partial(unit_vectors, model=embedder or Hashed(dims), dims=dims)
    small_batches(rows.sparkSession)

    def one(text: str) -> tuple[list | None, str | None]:
        try:
            return list(vectors([text])[0]), None
        except Exception as error:  # noqa: BLE001 - recorded with the text
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
            try:
                made, errors = list(vectors(texts)) if texts else [], [None] * len(texts)
            except Exception:
                if not guarded:
                    raise
                made, errors = zip(*map(one, texts), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(made, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[*keys, "embedding", "error"])

    schema = rows.select(*keys).schema.add("embedding", T.ArrayType(T.DoubleType())).add("error", "string")
    out = rows.select(*keys, column).mapInArrow(released(run), schema)
    return out if guarded else out.drop("error")


def terms(fragments: DataFrame) -> DataFrame:
    """Tokens and English stems of each fragment, with their numbers; fragments are in their canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(2).to_pylist()
            made = [[stem.stem(t) for t in own if not structure.is_cjk(t[0])] for own in tokens]
            sizes = [pa.array([len(x) for x in rows], pa.int32()) for rows in (tokens, made)]
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes[0], pa.array(made, pa.list_(pa.string())), sizes[1]], names=[f.split()[0] for f in TERMS.split(", ")])

    return fragments.select("fragment_id", "source_key", text.tokens(F.col("text")).alias("tokens")).mapInArrow(run, TERMS)


def terms_among(fragments: DataFrame, words: list[str], stems: list[str]) -> DataFrame:
    """terms() with all lengths, but of tokens and stems only those asked for: words that can't have such a stem are not stemmed."""
    wanted = frozenset(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[s for s in map(stem.stem, own) if s in wanted] for own in batch.column(4).to_pylist()]
            yield batch.set_column(4, "stems", pa.array(made, pa.list_(pa.string())))
        stem.stem.cache_clear()

    small_batches(fragments.sparkSession)
    made = fragments.select("fragment_id", "source_key", F.col("text").rlike(f"[{text.CJK}]").alias("mixed"), text.tokens(F.col("text")).alias("all"))
    other = F.when(F.col("mixed"), F.filter("all", lambda t: ~t.rlike(f"^[{text.CJK}]"))).otherwise(F.col("all"))
    made = made.select("fragment_id", "source_key", "all", other.alias("other"))
    few = made.select("fragment_id", "source_key", lexical.among(F.col("all"), words).alias("tokens"), F.size("all").alias("length"), F.filter("other", lambda t: stem.may_have(t, stems)).alias("stems"), F.size("other").alias("stem_length"))
    return few.mapInArrow(released(run), TERMS)


def opened(spark: SparkSession, root: str, settings: Settings) -> Segments:
    """The segmented tables of an index; those of other settings are another index."""
    return Segments(spark, f"{root}/{settings.fingerprint()}", TABLES)


def postings_of(store: Segments, name: str) -> Postings:
    """The full-text index of a field (one of FIELDS) in the state in force."""
    at = store.snapshot()
    if at is None:
        return Postings(store.spark, f"{store.root}/{name}", [], "string")
    there = [s for s in at.names if store.holds(name, s)]
    dead = store.dead(at)
    if dead is not None:
        gone = store._rows("fragments", FRAGMENTS, at.names).join(dead, (F.col("segment") == F.col("in_segment")) & (F.col("source_key") == F.col("key")), "left_semi")
        dead = gone.where("fragment_id IS NOT NULL").select("segment", F.col("fragment_id").alias("id"))
    return Postings(store.spark, f"{store.root}/{name}", there, "string", dead=dead)


def _indexed(change: Change, name: str, rows: DataFrame) -> None:
    """Write the full-text index of new rows of `terms`."""
    if name == "terms":
        for field, column in FIELDS.items():
            postings.write(rows.select(F.col("fragment_id").alias("id"), F.col(column).alias("tokens")), change.store.path(field, change.version))


def build(spark: SparkSession, root: str, roots: list[str], settings: Settings = Settings(), rebuild: bool = False, enrich: list[enrichment.Provider] | None = None, embedder: Embedder | None = None, chunker: Callable = structure.chunks) -> Report:
    """Bring the index at `root` up to the files below `roots`.

    Unchanged files are skipped, failed ones tried again, vanished ones removed; what a file had before
    goes, unless another file has the same source. Only what is new is chunked, embedded and indexed: it is a segment of its
    own, and what it replaces gets tombstones. A file that fails in any stage (parse, chunk, check, embed) is recorded with the
    stage and leaves the others alone. `enrich` lists providers of metadata. Everything becomes visible at the very end.
    """
    store = opened(spark, root, settings)
    change = store.change()
    old = spark.createDataFrame([], MANIFEST) if rebuild else store.read("manifest", MANIFEST)
    disk = files.discover(spark, roots, settings.ingest.max_file_mb).withColumn("hash", files.content_hash(F.col("content")))
    diff = change.work("changes", state.manifest_diff(disk.select("rel_path", "hash"), old))
    pending = diff.where("action IN ('added', 'updated', 'retried')").select("rel_path")
    parsed = described(files.parsed(disk.join(pending, "rel_path", "left_semi").select("rel_path", "hash", "content")).drop("content"))
    parsed = change.work("parsed", parsed)
    good = parsed.where("parsed.error IS NULL")
    # Of files with one source the first path provides its fragments.
    first = good.groupBy("source_key").agg(F.min("rel_path").alias("rel_path"))
    chosen = good.join(first, ["source_key", "rel_path"], "left_semi")
    docs = chosen.select("source_key", F.col("hash").alias("document_hash"), F.col("parsed.pages").alias("pages"))
    walked = change.add("fragments", chunking.fragments(docs, settings.ingest.chunking, chunker, guarded=True))
    fragments = walked.where("error IS NULL").drop("error")
    found = chosen.select("source_key", F.col("hash").alias("content_hash"), "rel_path", "title", "doi")
    sources = change.add("sources", enrichment.enriched(validation.cleaned(found), enrich or []).select(*_names(SOURCES)))
    vectors = change.add("vectors", embedded(fragments, settings.model.dims, embedder=embedder, guarded=True))
    _indexed(change, "terms", change.add("terms", terms(fragments)))
    checked(fragments, vectors, settings.model.dims)
    # One error for each source that failed: its rows in the new segment end at once.
    odd = lambda rows, kind: rows.withColumn("f", validation.faults(rows, kind)).where(F.size("f") > 0).select("source_key", F.lit("check").alias("stage"), F.concat(F.lit(f"{kind}: "), F.array_join("f", ", ")).alias("error"))
    staged = lambda rows, stage: rows.where("error IS NOT NULL").select("source_key", F.lit(stage).alias("stage"), "error")
    errors = staged(walked, "chunk").unionByName(staged(vectors, "embed")).unionByName(odd(fragments, "fragment")).unionByName(odd(sources, "source"))
    errors = change.work("errors", errors.groupBy("source_key").agg(F.min(F.concat("stage", F.lit(": "), "error")).alias("failure")))
    # What goes: sources that are built anew, or that no remaining file has.
    skipped = old.join(diff.where("action = 'skipped'").select("rel_path"), "rel_path", "left_semi")
    alive = skipped.where("status = 'ok'").select("source_key").distinct().join(good.select("source_key").distinct(), "source_key", "left_anti")
    if not rebuild:
        stale = store.read("sources", SOURCES).select("source_key").unionByName(store.read("fragments", FRAGMENTS).select("source_key")).distinct().join(alive, "source_key", "left_anti")
        change.end(stale, errors.select("source_key"))
    else:
        change.end(None, errors.select("source_key"))
    counts = fragments.join(errors, "source_key", "left_anti").groupBy("source_key").agg(F.count("*").alias("fragment_count"))
    failure = F.coalesce(F.concat(F.lit("parse: "), F.col("parsed.error")), F.col("failure"))
    entries = parsed.join(counts, "source_key", "left").join(errors, "source_key", "left").select(
        "rel_path", "hash", "source_key", F.when(failure.isNull(), "ok").otherwise("failed").alias("status"), failure.alias("error"), F.coalesce("fragment_count", F.lit(0)).cast("long").alias("fragment_count")
    )
    manifest = change.replace("manifest", skipped.select(*entries.columns).unionByName(entries))
    actions = {r.action: r.n for r in diff.groupBy("action").agg(F.count("*").alias("n")).collect()}
    failed = [(r.rel_path, r.error) for r in manifest.where("status = 'failed'").orderBy("rel_path").limit(LISTED).collect()]
    doubles = [(r.source_key, r.paths) for r in manifest.where("status = 'ok'").groupBy("source_key").agg(F.sort_array(F.collect_list("rel_path")).alias("paths")).where(F.size("paths") > 1).orderBy("source_key").limit(LISTED).collect()]
    number = manifest.where("status = 'failed'").count() if len(failed) == LISTED else len(failed)
    change.commit(fresh=rebuild)
    return Report(change.version, actions, number, store.read("fragments", FRAGMENTS).count(), len(doubles), failed, doubles)


def stored(root: str, fragments: DataFrame, sources: DataFrame, settings: Settings, scanned: bool = False) -> Segments:
    """An index of one segment, of fragments (FRAGMENTS) and sources that are at hand; if it is to be `scanned`, of nothing else."""
    store = opened(fragments.sparkSession, root, settings)
    change = store.change()
    made = change.add("fragments", fragments.select(*_names(FRAGMENTS)))
    change.add("sources", enrichment.enriched(sources, []).select(*_names(SOURCES)))
    if not scanned:
        change.add("vectors", embedded(made, settings.model.dims))
        _indexed(change, "terms", change.add("terms", terms(made)))
    change.commit()
    return store


def checked(fragments: DataFrame, vectors: DataFrame, dims: int) -> None:
    """Every new fragment has its vector, or an error, and vectors have the index's dimension; otherwise nothing becomes visible."""
    n, row = fragments.count(), vectors.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != dims).alias("wrong")).first()
    if row.n != n or row.wrong:
        raise ValueError(f"{row.n} vectors for {n} fragments, {row.wrong} of another dimension than {dims}")


def maintain(spark: SparkSession, root: str, settings: Settings = Settings(), least: int = 10_000, keep: int = 2) -> tuple[str | None, int]:
    """Merge small segments and those with many removed rows, and remove the files that the last `keep` snapshots don't need."""
    store = opened(spark, root, settings)
    merged = store.merge({"fragments": FRAGMENTS, "sources": SOURCES, "vectors": VECTORS, "terms": TERMS}, least, rewrite=_indexed)
    return merged, store.vacuum(keep)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
