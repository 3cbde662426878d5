"""Files to an index and back: increments, faults, questions, agent, command line."""

import json
from dataclasses import replace

import pytest

from veinstone import cli
from veinstone.operators import evaluation
from veinstone.plans import ask, ingest, models, prompts, settings
from veinstone.sources import files, records
from veinstone.sources.store import Store

CFG = replace(settings.Settings(), ingest=settings.Ingest(target=200, most=400, least=40, overlap=20), model=settings.Model(dims=16))


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("# Graph search\n\nGraph search finds near neighbours quickly. It keeps a list.\n\nDOI 10.1234/abc.\n")
    (root / "sub" / "b.md").write_text("# Token files\n\nToken files pack small numbers into words. Numbers are packed by size.\n" * 3)
    (root / "c c+d.txt").write_bytes("中文文档。检索增强生成需要证据。".encode("gb18030"))
    (root / ".hidden.txt").write_text("never seen")
    (root / "x.bin").write_text("never seen")
    (root / "bad.pdf").write_bytes(b"not a pdf")
    return root


def texts(spark, index):
    return {r.text for r in ask.Index.open(spark, index, CFG).fragments.collect()}


def test_whole_texts_are_embedded(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(3000)) + "é" * 7
    vector = [0.0] * 16
    for k, c in enumerate(text):
        vector[k % 16] += ord(c) % 97 / 97
    length = sum(x * x for x in vector) ** 0.5
    row = ingest.embedded(spark.createDataFrame([("f", "s", text)], "fragment_id string, source_key string, text string"), 16).first()
    assert row.embedding == pytest.approx([x / length for x in vector])


def test_increments(spark, tmp_path, corpus):
    index = str(tmp_path / "index")
    first = ingest.build(spark, index, [str(corpus), str(tmp_path / "missing")], CFG)
    assert first.actions == {"added": 4} and first.failed == 1 and first.ok
    assert any("证据" in t for t in texts(spark, index))
    again = ingest.build(spark, index, [str(corpus)], CFG)
    assert again.actions == {"skipped": 3, "retried": 1} and again.fragments == first.fragments
    (corpus / "a.txt").write_text("Changed contents only here.")
    (corpus / "sub" / "b.md").unlink()
    (corpus / "twin.txt").write_text("Changed contents only here.")
    third = ingest.build(spark, index, [str(corpus)], CFG)
    assert third.actions == {"updated": 1, "removed": 1, "skipped": 1, "retried": 1, "added": 1}
    assert third.duplicate_sources == 1
    assert "Changed contents only here." in texts(spark, index) and not any("pack small" in t or "near neighbours" in t for t in texts(spark, index))
    status = ask.Index.open(spark, index, CFG).status()
    assert status["files"] == 4 and status["failed"] == 1 and status["version"] == third.version


def test_failed_build_leaves_the_old_version(spark, tmp_path, corpus, monkeypatch):
    index = str(tmp_path / "index")
    before = ingest.build(spark, index, [str(corpus)], CFG)
    monkeypatch.setattr(ingest, "checked", lambda *a: (_ for _ in ()).throw(ValueError("broken")))
    (corpus / "new.txt").write_text("new text")
    with pytest.raises(ValueError):
        ingest.build(spark, index, [str(corpus)], CFG)
    assert ask.Index.open(spark, index, CFG).store.current() == before.version


def test_other_schema_is_no_version(spark, tmp_path):
    (tmp_path / "CURRENT").write_text(json.dumps({"version": "v-1", "schema": 99}))
    assert Store(spark, str(tmp_path)).current() is None
    (tmp_path / "CURRENT").write_text("garbage")
    assert Store(spark, str(tmp_path)).current() is None


@pytest.fixture
def index(spark, tmp_path, corpus):
    ingest.build(spark, str(tmp_path / "index"), [str(corpus)], CFG)
    return ask.Index.open(spark, str(tmp_path / "index"), CFG)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, start=1)), "query_id long, query string")


@pytest.mark.parametrize("strategy", ask.STRATEGIES)
def test_search(spark, index, strategy):
    rows = ask.search(index, asked(spark, "token files pack numbers", "  "), 2, strategy).collect()
    assert {r.query_id for r in rows} == {1} and sorted(r["rank"] for r in rows) == [1, 2]
    assert ask.search(index, asked(spark, "graph"), 0, strategy).collect() == []
    nothing = spark.createDataFrame([], "source_key string")
    assert ask.search(index, asked(spark, "graph search"), 2, strategy, nothing).collect() == []


def test_lexical_route_finds_the_words(spark, index):
    best = ask.search(index, asked(spark, "pack small numbers"), 1, "hybrid_rrf_rerank").collect()[0]
    own = {r.fragment_id: r.text for r in index.fragments.collect()}
    assert "pack small numbers" in own[best.id] and best.origin == "rerank"


def test_stems_match(spark, index):
    best = ask.search(index, asked(spark, "packing sizes"), 1, "hybrid_rrf").collect()
    own = {r.fragment_id: r.text for r in index.fragments.collect()}
    assert len(best) == 1 and "packed by size" in own[best[0].id]


def test_unknown_strategy(spark, index):
    with pytest.raises(ValueError):
        ask.search(index, asked(spark, "x"), strategy="none")


def test_answers(spark, index):
    rows = {r.query_id: r for r in ask.ask(index, asked(spark, "Graph search finds near neighbours", "zzz qqq")).collect()}
    assert not rows[1].refused and rows[1].citations and "near neighbours" in rows[1].text and "ev-" not in rows[1].text
    assert rows[2].refused and rows[2].text == ""


def test_agent(spark, index):
    agent = ask.Agent(index, ask.deterministic)
    state, status = agent.run("Graph search finds near neighbours")
    assert status == "SUCCESS" and [a["tool"] for a in state.actions] == ["search_literature", "gather_evidence", "answer_question", "finish"]
    idle, status = ask.Agent(index, lambda s: ("gather_evidence", {"query": "zzz"})).run("zzz")
    assert status == "TRUNCATED" and "no_new_evidence" in idle.notes
    odd, _ = ask.Agent(index, lambda s: ("nonsense", {}) if not s.actions else ("reset_scope", {"x": 1}) if len(s.actions) == 1 else None).run("q")
    assert [a["observation"].split(":")[0] for a in odd.actions] == ["unknown tool", "bad arguments"]


def test_models(spark):
    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise models.TransientError("later")
        return [models.Response("ok") for _ in prompts]

    assert models.with_retries(flaky, 3, 0, lambda s: None)(["a"])[0].content == "ok"
    assert models.with_retries(lambda p: 1 / 0)(["a"])[0].error.startswith("ZeroDivisionError")
    rows = models.complete(spark.createDataFrame([("not json",)], "p string"), "p").collect()
    assert rows[0].response.error


@pytest.mark.parametrize(("data", "text"), [("é中".encode(), "é中"), ("﻿x".encode(), "x"), ("中文".encode("gb18030"), "中文"), ("plain".encode("utf-16"), "plain"), (b"", "")])
def test_decode(data, text):
    assert files.decode(data) == text


def test_parsers(spark):
    files.register_parser(".shout", "shout", lambda b: [(1, b.decode().upper())])
    rows = spark.createDataFrame([("a.shout", b"hi"), ("b.none", b""), ("c.txt", b"p1\fp2")], "rel_path string, content binary")
    out = {r.rel_path: r.parsed for r in files.parsed(rows).collect()}
    assert out["a.shout"].pages[0].text == "HI" and out["b.none"].error and len(out["c.txt"].pages) == 2


def test_records(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"k": 1, "v": "a"}\nbroken\n{"k": 1, "v": "b"}\n')
    assert [r.v for r in records.read_jsonl(spark, str(tmp_path / "s.jsonl"), "k long, v string").collect()] == ["a", "b"]
    (tmp_path / "cases.jsonl").write_text('# note\n\n{"question": "q", "expected_keywords": ["a|b"]}\n{"no": 1}\nbad\n')
    cases = records.read_cases(spark, str(tmp_path / "cases.jsonl")).collect()
    assert len(cases) == 1 and cases[0].expected_answerable and cases[0].expected_keywords == ["a|b"]
    (tmp_path / "r.csv").write_text("Title,OriginalPaperDOI\nx,https://doi.org/10.1/A\ny,\n")
    assert [r.doi for r in records.read_retractions(spark, str(tmp_path / "r.csv")).collect()] == ["10.1/a"]
    assert records.read_retractions(spark, str(tmp_path / "none.csv")).collect() == []


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("VEINSTONE_RETRIEVAL__K=3\nVEINSTONE_MODEL__API_KEY='s'\n# x\n")
    (tmp_path / "p.json").write_text('{"retrieval": {"k": 4, "lambda": 0.1}}')
    monkeypatch.setenv("VEINSTONE_SCREENING__MIN_RELEVANCE", "7")
    made = settings.load(tmp_path / "p.json", {"ingest": {"target": 1000}}, tmp_path / ".env")
    assert (made.retrieval.k, made.retrieval.lambda_, made.screening.min_relevance, made.ingest.target) == (4, 0.1, 7, 1000)
    assert made.shown()["model"]["api_key"] == "***"
    assert made.fingerprint() != settings.Settings().fingerprint()
    for bad in ({"nope": {}}, {"retrieval": {"nope": 1}}, {"ingest": {"least": 10**6}}):
        with pytest.raises(ValueError):
            settings.load(None, bad, tmp_path / "none")


def test_command_line(spark, tmp_path, corpus, capsys, monkeypatch):
    at = ["--index", str(tmp_path / "i"), "--json"]
    assert cli.run([*at, "index", str(corpus)]) == 0
    assert json.loads(capsys.readouterr().out)["failed"] == 1
    assert cli.run([*at, "ask", "Graph search finds near neighbours"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "SUCCESS"
    assert cli.run([*at, "sessions", "GRAPH"]) == 0
    assert len(json.loads(capsys.readouterr().out)["sessions"]) == 1
    assert cli.run([*at, "search", "token files", "-k", "1"]) == 0
    assert cli.run([*at, "status"]) == 0
    assert cli.run([*at, "config"]) == 0
    assert cli.run(["--profile", str(tmp_path / "none.json"), "config"]) == 1
    assert cli.run([*at, "maintain"]) == 0
    monkeypatch.setattr(cli, "_keep_session", lambda *_: 1 / 0)
    capsys.readouterr()
    assert cli.run([*at, "ask", "Graph search finds near neighbours"]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["status"] == "SUCCESS" and "not kept" in said.err
    with pytest.raises(SystemExit) as wrong:
        cli.run(["nonsense"])
    assert wrong.value.code == 2


def test_evaluation_run(spark, index):
    cases = spark.createDataFrame([("a", "Graph search finds near neighbours", True, ["graph|tree"], ["banana"]), ("b", "zzz qqq", False, [], [])], "id string, question string, expected_answerable boolean, expected_keywords array<string>, forbidden_keywords array<string>")
    results = ask.evaluated(index, cases, repeat=2)
    row = evaluation.summary(results).first()
    assert (row.total, row.behavior_correctness, row.answer_coverage, row.hallucination_rate, row.citation_resolution_rate) == (4, 1.0, 1.0, 0.0, 1.0)

    class Broken(ask.Index):
        @property
        def fragments(self):
            raise RuntimeError("gone")

    failed = ask.evaluated(Broken(spark, index.store, CFG), cases).collect()
    assert all(r.error and r.refused for r in failed)


def test_presummary(spark):
    rows = spark.createDataFrame([(1, "graph", k, f"About a graph {k}. More.", k) for k in range(1, 5)], "query_id long, query string, id long, text string, rank int")
    out = {r.id: r for r in ask.presummarised(rows, 3, 5).collect()}
    assert set(out) == {1, 2, 3} and [out[k].relevance for k in (1, 2, 3)] == [10, 7, 5] and all(r.summary for r in out.values())


def test_prompts():
    assert "why" in prompts.render("screen", "English", question="why", citation="c", text="t")
    assert "问题" in prompts.render("answer", "中文", question="q", context="c")
    for bad in (lambda: prompts.render("screen", question="q"), lambda: prompts.render("screen", "fr"), lambda: prompts.render("none")):
        with pytest.raises(ValueError):
            bad()


def test_audit_of_trees(spark, tmp_path, capsys):
    for name, text in {"a/own.py": "import os\n\n\ndef total(rows):\n    return sum(rows)\n", "b/other.py": "import os\n\nPROMPT = 'a quite different piece of wording here'\n", "c/copy.py": "import os\n\n\ndef total(rows):\n    return sum(rows)\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    for k in range(20):  # words of few files are not common
        (tmp_path / "a" / f"f{k}.py").write_text(f"other{k} = thing{k}\n")
    at = ["--json", "audit", str(tmp_path / "a")]
    assert cli.run([*at, str(tmp_path / "b")]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["passed"] and {c["name"] for c in out["checks"]} == {"ngrams", "blocks", "lines", "assets", "strings"}
    assert cli.run([*at, str(tmp_path / "b"), str(tmp_path / "c")]) == 1
    failed = {c["name"] for c in json.loads(capsys.readouterr().out)["checks"] if c["failed"]}
    assert "assets" in failed and "lines" in failed
