"""The pipeline's stages one by one, and the whole run, on a small table."""

import random

import corpus_pipeline as C


def rows():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("the", "and", "tion", "ing", "er", "st") for b in ("of", "in", "th", "re", "on", "at")]
    shared = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4))
    out = []
    for k in range(60):
        own = "\n".join(" ".join(rng.choice(words) for _ in range(15)) for _ in range(6))
        out.append((k, own + ("\n" + shared if k % 10 == 0 else ""), "en", ["a", "b", None][k % 3]))
    out += [(100, out[1][1], "en", "a"), (101, out[2][1].replace("theof", "Changed", 1), "en", "b"), (102, None, "en", "a"), (103, "12 34 ...", None, "b"), (104, "", "en", "a"), (1, out[1][1], "en", "b")]
    return out


def test_stages(spark, docs):
    table = docs(rows())
    assert [name for name, _ in C.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "tokenize"] and C.ORACLE_SQL is None
    known = C.language_id(spark, table, "")
    assert known.columns == table.columns and {r.doc_id for r in known.collect()} == set(range(60)) | {100, 101}
    short = C.line_dedup(spark, known, "")
    left = {r.doc_id: r for r in short.collect()}
    assert 100 not in left and all(r.n_chars == len(r.text) for r in left.values())
    assert sum("\n" in r.text and len(r.text.split("\n")) == 10 for r in left.values()) == 1 and len(left[10].text.split("\n")) == 6
    single = C.near_dedup(spark, docs([(r.doc_id, r.text, r.lang, r.source) for r in known.collect()]), "")
    assert sorted(r.doc_id for r in single.collect()) == list(range(60))
    mixed = C.mix(spark, single, "")
    assert mixed.columns == table.columns and 60 <= mixed.count() <= 120
    done = C.tokenize(spark, mixed, "").collect()
    assert len(done) == mixed.count() and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in done)


def test_run(spark, docs, tmp_path):
    docs(rows()).write.parquet(str(tmp_path / "documents.parquet"))
    out = C.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.collect()}
    assert kept <= set(range(60)) and len(kept) > 40 and "n_tokens" in out.columns


def test_empty(spark, docs):
    table = docs([])
    for _, stage in C.STAGES:
        table = stage(spark, table, "")
        assert table.collect() == []


def test_hard_rows(spark, docs, hard):
    """Every stage on nulls, blanks, repeats and long texts, with columns whose names clash with inner ones."""
    table = docs([(k, t, "en" if k != 3 else None, ["a", None][(k or 0) % 2]) for k, t in hard]).selectExpr("*", "1 AS size", "2 AS key", "3 AS hash", "4 AS repeats", "'x' AS ids", "5 AS node")
    known = C.language_id(spark, table, "").collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in known) == [-1, 4, 5, 5, 6, 7, 8, 9]
    short = C.line_dedup(spark, table, "").collect()
    # The third copy of the three-line windows loses its lines, and so the whole document.
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in short) == [-1, 1, 2, 3, 4, 5, 5, 7, 8, 9]
    single = C.near_dedup(spark, table, "").collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in single) == [-1, 1, 4, 5, 7, 8, 9]
    mixed = C.mix(spark, table, "")
    taken = [-1 if r.doc_id is None else r.doc_id for r in mixed.collect()]
    assert mixed.columns == C.COLUMNS and set(taken) <= {-1, 4, 5, 6, 7, 8, 9} and max(map(taken.count, taken)) <= 4
    done = C.tokenize(spark, table, "").collect()
    assert len(done) == len(hard) and all(r.round_trip for r in done) and {r.doc_id for r in done if r.n_tokens == 0} == {1, 2}
