"""Metadata of sources from providers, asked side by side under deadlines.

A provider is asked for a source by a function on the executors. All providers of a source run at once, each in
a thread; what has not come by a provider's deadline is no contribution, as is what fails. Contributions
are merged by field as any others.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metadata

#: Fields that a provider may give, and their types.
FIELDS = {"title": "string", "authors": "array<string>", "year": "int", "venue": "string", "doi": "string"}
_TYPES = {"title": pa.string(), "authors": pa.list_(pa.string()), "year": pa.int32(), "venue": pa.string(), "doi": pa.string()}
OUTCOMES = "source_key string, provider string, outcome string, confidence string, score double, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items())


class Provider(NamedTuple):
    """`fetch` gets a source (source_key, title, doi) and returns fields with confidence (doi or title) and score, or None."""

    name: str
    fetch: Callable[[dict], dict | None]
    deadline: float = 10.0


def asked(source: dict, providers: list[Provider]) -> list[dict]:
    """One outcome for each provider: found, nothing, failed or late. Costs the longest deadline at most."""
    done: dict[str, dict] = {}

    def call(p: Provider) -> None:
        try:
            found = p.fetch(dict(source))
            fields = {f: found.get(f) for f in FIELDS} if found else {}
            made = {"outcome": "found", "confidence": found.get("confidence", "doi" if source.get("doi") else "title"), "score": float(found.get("score", 1.0)), **fields} if found else {"outcome": "nothing"}
            for f, v in fields.items():
                pa.array([v], _TYPES[f])  # a value of another type is a failure of its provider
        except Exception as error:  # noqa: BLE001 - recorded as the outcome
            made = {"outcome": f"failed: {type(error).__name__}: {error}"}
        done[p.name] = made

    # Daemon threads: one that never ends doesn't hold the task.
    threads = [threading.Thread(target=call, args=(p,), daemon=True) for p in providers]
    began = time.monotonic()
    for t in threads:
        t.start()
    out = []
    for t, p in sorted(zip(threads, providers, strict=True), key=lambda x: x[1].deadline):
        t.join(max(0.0, began + p.deadline - time.monotonic()))
        out.append({"source_key": source["source_key"], "provider": p.name, **dict(done.get(p.name, {"outcome": "late"}))})
    return out


def outcomes(sources: DataFrame, providers: list[Provider], side_by_side: int = 8) -> DataFrame:
    """What each provider says of each source (source_key, title, doi), `side_by_side` sources of a task at a time."""
    names = [c.split()[0] for c in OUTCOMES.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), *_TYPES.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), side_by_side):
                part, found = rows[k : k + side_by_side], []
                lanes = [threading.Thread(target=lambda s: found.extend(asked(s, providers)), args=(s,)) for s in part]
                for lane in lanes:
                    lane.start()
                for lane in lanes:
                    lane.join()
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in found], t) for c, t in zip(names, types, strict=True)], names=names)

    return sources.select("source_key", "title", "doi").mapInArrow(run, OUTCOMES)


def enriched(sources: DataFrame, providers: list[Provider]) -> DataFrame:
    """`sources` with authors, year and venue, gaps of title and DOI filled, and metadata_complete (title, authors and year are there)."""
    blank = [F.lit(None).cast(t).alias(f) for f, t in FIELDS.items() if f not in sources.columns]
    own = sources.select("*", *blank)
    if providers:
        names = list(FIELDS)
        merged = metadata.merge(outcomes(own, providers).where("outcome = 'found'"), names)
        filled = metadata.fill(own.select("source_key", *names), merged, names).withColumnRenamed("source_key", "filled_key")
        own = own.drop(*names).join(filled, F.col("source_key") == F.col("filled_key")).drop("filled_key")
    return own.withColumn("metadata_complete", F.col("title").isNotNull() & (F.coalesce(F.size("authors"), F.lit(0)) > 0) & F.col("year").isNotNull())
