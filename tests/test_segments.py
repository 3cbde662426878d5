"""Segments: changes, crashes, merges, vacuum; builds that do only what is new, isolate faults and ask providers."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veinstone.operators import dense, enrichment, lexical
from veinstone.plans import ask, ingest, settings
from veinstone.sources.segments import Conflict, Segments

CFG = replace(settings.Settings(), ingest=settings.Ingest(target=200, most=400, least=40, overlap=20), model=settings.Model(dims=16))
ROWS = "source_key string, x int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def live(store):
    return sorted((r.source_key, r.x) for r in store.read("t", ROWS).collect())


def change(store, spark, new=(), gone=()):
    made = store.change()
    made.add("t", rows(spark, *new) if new else rows(spark, ("z", 0)).where("false"))
    made.end(spark.createDataFrame([(k,) for k in [*gone, *(k for k, _ in new)]], "source_key string"))
    return made


def test_changes_and_history(spark, tmp_path):
    store = Segments(spark, str(tmp_path), ("t",))
    assert live(store) == [] and store.vacuum() == 0 and store.merge({"t": ROWS}, 9) is None
    change(store, spark, [("a", 1), ("b", 2), ("b", 3)]).commit()
    change(store, spark, [("b", 4), ("c", 5)]).commit()
    assert live(store) == [("a", 1), ("b", 4), ("c", 5)]
    change(store, spark, [], ["a", "none"]).commit()
    assert live(store) == [("b", 4), ("c", 5)]
    # A key that comes back is not hit by its old tombstone.
    change(store, spark, [("a", 6)]).commit()
    assert live(store) == [("a", 6), ("b", 4), ("c", 5)] and len(store.history()) == 4
    assert store.merge({"t": ROWS}, 100) and live(store) == [("a", 6), ("b", 4), ("c", 5)]
    assert len(store.snapshot().segments) == 1 and not store.snapshot().dead
    assert store.merge({"t": ROWS}, 100) is None
    assert store.vacuum(2) > 0 and len(store.history()) == 2
    assert store.vacuum(1) > 0 and live(store) == [("a", 6), ("b", 4), ("c", 5)] and store.vacuum(1) == 0


@pytest.mark.parametrize("step", ["write", "put", "commit"])
def test_a_crash_leaves_the_old_snapshot(spark, tmp_path, monkeypatch, step):
    store = Segments(spark, str(tmp_path), ("t",))
    change(store, spark, [("a", 1)]).commit()

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(Segments, step, crash)
        with pytest.raises(RuntimeError):
            change(store, spark, [("a", 2)]).commit()
    assert live(store) == [("a", 1)]
    change(store, spark, [("a", 3)]).commit()
    assert live(store) == [("a", 3)] and store.vacuum() > 0 and live(store) == [("a", 3)]


def test_two_writers(spark, tmp_path):
    store = Segments(spark, str(tmp_path), ("t",))
    one, two = change(store, spark, [("a", 1)]), change(store, spark, [("b", 1)])
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert live(store) == [("a", 1)]


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    for name in ("graphs", "tokens", "vectors"):
        (root / f"{name}.txt").write_text(f"# About {name}\n\nThis paper is about {name} only, and how {name} are packed. DOI 10.1234/{name}.\n")
    return root


def test_only_what_is_new_is_embedded(spark, tmp_path, corpus):
    at, seen = str(tmp_path / "i"), spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return ingest.Hashed(16)(texts)

    first = ingest.build(spark, at, [str(corpus)], CFG, embedder=model)
    assert first.fragments >= 3
    before = spark.read.parquet(f"{ingest.opened(spark, at, CFG).path('vectors', first.version)}").count()
    (corpus / "tokens.txt").write_text("Changed to something about trees.")
    (corpus / "vectors.txt").unlink()
    second = ingest.build(spark, at, [str(corpus)], CFG, embedder=model)
    store = ingest.opened(spark, at, CFG)
    assert before == first.fragments and spark.read.parquet(store.path("vectors", second.version)).count() == 1
    assert second.actions == {"skipped": 1, "updated": 1, "removed": 1}
    index = ask.Index.open(spark, at, CFG)
    own = {r.fragment_id: r.text for r in index.fragments.collect()}
    assert second.fragments == len(own) == index.vectors.count()
    # Full-text search of the segments is that of the live fragments in one.
    words = spark.createDataFrame([(1, "about"), (1, "packed"), (1, "trees"), (1, "vectors")], "query_id long, term string")
    tokens = ingest.terms(index.fragments).select(F.col("fragment_id").alias("id"), "tokens", "length")
    expected = sorted(dense.ranked(lexical.bm25(tokens, words), 5).collect())
    assert sorted(dense.ranked(index.lexical("words", words, None), 5).collect()) == expected
    merged, gone = ingest.maintain(spark, at, CFG)
    assert merged and gone > 0 and {r.fragment_id: r.text for r in index.fragments.collect()} == own
    assert sorted(dense.ranked(index.lexical("words", words, None), 5).collect()) == expected and index.status()["fragments"] == len(own)


@pytest.mark.parametrize("stage", ["parse", "chunk", "embed", "check"])
def test_a_fault_marks_one_file(spark, tmp_path, corpus, stage):
    def model(texts):
        if stage == "embed" and any("graphs" in t for t in texts):
            raise OSError("no model")
        return ingest.Hashed(16)(texts)

    def walk(pages, chunking):
        from veinstone.functions import structure

        made = structure.chunks(pages, chunking)
        if any("graphs" in t for _, t in pages):
            if stage == "chunk":
                raise ZeroDivisionError("broken walk")
            if stage == "check":
                return [u._replace(text="  ") for u in made]
        return made

    if stage == "parse":
        (corpus / "graphs.txt").unlink()
        (corpus / "graphs.pdf").write_bytes(b"no pdf")
    report = ingest.build(spark, str(tmp_path / "i"), [str(corpus)], CFG, embedder=model, chunker=walk)
    assert report.failed == 1 and report.failures[0][0].startswith("corpus/graphs") and report.failures[0][1].startswith(f"{stage}: ")
    index = ask.Index.open(spark, str(tmp_path / "i"), CFG)
    assert not any("graphs" in r.text for r in index.fragments.collect()) and report.fragments == index.vectors.count() >= 2
    # Tried again, and mended.
    if stage != "parse":
        again = ingest.build(spark, str(tmp_path / "i"), [str(corpus)], CFG)
        assert again.actions == {"skipped": 2, "retried": 1} and again.failed == 0 and any("graphs" in r.text for r in index.fragments.collect())


def test_providers(spark, tmp_path, corpus):
    def crossref(source):
        return {"title": "Better", "authors": ["A. One"], "year": 2020, "confidence": "doi"} if source["doi"] == "10.1234/graphs" else None

    def other(source):
        return {"venue": "V", "year": 1999, "authors": ["Wrong"], "confidence": "title", "score": 0.9}

    def stalled(source):
        time.sleep(60)

    providers = [enrichment.Provider("crossref", crossref), enrichment.Provider("openalex", other), enrichment.Provider("slow", stalled, 0.3), enrichment.Provider("broken", lambda s: 1 / 0), enrichment.Provider("odd", lambda s: {"year": "x"})]
    began = time.monotonic()
    found = enrichment.asked({"source_key": "k", "title": "t", "doi": "10.1234/graphs"}, providers)
    assert 0.3 <= time.monotonic() - began < 5
    assert {f["provider"]: f["outcome"].split(":")[0] for f in found} == {"crossref": "found", "openalex": "found", "slow": "late", "broken": "failed", "odd": "failed"}
    ingest.build(spark, str(tmp_path / "i"), [str(corpus)], CFG, enrich=providers)
    out = {r.doi: r for r in ask.Index.open(spark, str(tmp_path / "i"), CFG).sources.collect()}
    assert (out["10.1234/graphs"].authors, out["10.1234/graphs"].year, out["10.1234/graphs"].venue) == (["A. One"], 2020, "V")
    assert out["10.1234/tokens"].year == 1999 and all(r.metadata_complete for r in out.values())
