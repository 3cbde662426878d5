import difflib
import random
import re

from pyspark.sql import functions as F

from veinstone.functions.text import from_bytes
from veinstone.operators import audit
from veinstone.sources.files import source_tree


def test_dependencies(spark):
    rows = [("pyproject.toml", '[project]\ndependencies = ["Num_Py>=1", "x[y]"]\n[project.optional-dependencies]\nd = ["pytest"]'), ("requirements.txt", "# c\nFoo.Bar==1\n-r x\n"), ("a.py", "import os.path, json\nfrom a.b import c\nfrom . import d\nimportlib.import_module('lazy.x')"), ("broken.py", "import ok\ndef ("), ("bad.toml", "["), ("z.md", "import none")]
    out = audit.dependency_rows(spark.createDataFrame(rows, "rel_path string, text string"))
    found = {}
    for r in out.collect():
        found.setdefault(r.rel_path, set()).add(r.package)
    assert found == {"pyproject.toml": {"num-py", "x", "pytest"}, "requirements.txt": {"foo-bar"}, "a.py": {"os", "json", "a", "lazy"}, "broken.py": {"ok"}}
    rules = spark.createDataFrame([("numpy", "banned"), ("os", "warn")], "rule string, level string")
    assert {(r.package, r.level) for r in audit.dependency_hits(out, rules).collect()} == {("num-py", "banned"), ("os", "warn")}


def test_literals_and_identifiers(spark):
    code = 'x = "a literal of more than twenty"  # secret name\ny = "short"\nname = 1\n'
    files = spark.createDataFrame([("a.py", code), ("b.txt", 'its "quoted text of some length" (')], "rel_path string, text string")
    assert {(r.rel_path, r.literal) for r in audit.literal_rows(files).collect()} == {("a.py", "a literal of more than twenty"), ("b.txt", "quoted text of some length")}
    hits = {(r.rel_path, r.kind, r["name"], r.hits) for r in audit.identifier_hits(files, ["NAME", "literal"]).collect()}
    assert hits == {("a.py", "comment", "NAME", 1), ("a.py", "code", "NAME", 1), ("a.py", "string", "literal", 1)}


def test_nearest_strings(spark):
    t = ["a prompt about screening evidence", "something else entirely", "10.1234/x"]
    r = ["a prompt about screening the evidence", "a promise", "10.9999/y and more text that goes on", "zzz"]
    out = {x.s: (x.r, round(x.similarity, 9)) for x in audit.nearest_strings(spark.createDataFrame([(x,) for x in t], "s string"), spark.createDataFrame([(x,) for x in r], "s string")).collect()}
    brute = {}
    for a in t:
        score, b = max((difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), b) for b in r)
        if score >= 0.6:
            brute[a] = (b, round(score, 9))
    assert out == brute and out


def test_nearest_strings_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(audit, "STRINGS", 60)
    rng = random.Random(3)
    words = ["ab", "cd", "ef", "gh", "screen", "evidence", "中文", "10.1234/x"]
    say = lambda: rng.choice("-_ ").join(rng.choice(words) for _ in range(rng.randint(1, 12)))
    t, r = [*(say() for _ in range(250)), "ab-cd-ef-gh-ij-kl-mn", "ab"], [*(say() for _ in range(250)), "ab_cd_ef_gh_ij_kl_mn", "abc"]
    found = audit.nearest_strings(spark.createDataFrame([(x,) for x in t], "s string"), spark.createDataFrame([(x,) for x in r], "s string"), 0.6, 20)
    expected = {}
    for a in set(t):
        scored = [(difflib.SequenceMatcher(None, a, b, autojunk=False), b) for b in set(r)]
        scored = [(m.ratio(), b, sum(x.size for x in m.get_matching_blocks())) for m, b in scored]
        good = [x for x in scored if x[0] >= 0.6]
        if good:
            expected[a] = (*max(good), any(x[2] >= 20 for x in good))
    out = {x.s: (x.similarity, x.r, x.matched, x.violation) for x in found.collect()}
    assert out == expected and "ab-cd-ef-gh-ij-kl-mn" in out and out["ab"]
    listed = audit.worst_first(found, 30).collect()
    assert [(not x.violation, -x.similarity, -x.matched, x.s) for x in listed] == sorted((not v[3], -v[0], -v[2], s) for s, v in out.items())[:30]


def test_the_bound_spares_most_pairs():
    rng = random.Random(4)
    strings = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30)) for _ in range(200)]
    found, done = audit.compared(strings[:100], [*strings[100:], strings[0]], 0.6, 20)
    assert [f[0] for f in found] == [strings[0]] and done < 0.3 * 100 * 101


def test_names_by_one_automaton(spark):
    names = ["he", "she", "hers", "his", "a.b", "x_y", "Straße", "中"]
    texts = ["She said he is hers, not his; SHE-he", "ushers he_ _he he1 he", "a.b A.B axb a.bc", "x_y x_yz", "straße STRASSE", "中文 中 x中", "", None]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id long, text string, n int")
    out = {(r.id, r["name"], r.hits) for r in audit.name_hits(rows, names).collect()}
    expected = {(k, n, c) for k, t in enumerate(texts) if t for n in names if (c := len(re.findall(rf"(?<![A-Za-z0-9_])(?={re.escape(n.lower())}(?![A-Za-z0-9_]))", t.lower())))}
    assert out == expected
    assert audit.name_hits(rows, []).collect() == []


def test_spans_and_trees(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {"a.py": b'x = "lit"  # note\n', "b.html": b"<p class='x'>hi<!-- no --> there</p>", "bin.dat": b"a\0b", "node_modules/skip.js": b"x", ".git/y": b"x", "sub/build/z.c": b"x", "sub/ok.c": "é".encode("latin-1"), "big.txt": b"y" * 6_000_000}.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    tree = source_tree(spark, [str(root)])
    assert {r.rel_path for r in tree.collect()} == {"tree/a.py", "tree/b.html", "tree/sub/ok.c"}
    rows = {(r.rel_path, r.kind, r.place): r.part for r in audit.spanned(tree, "text", "f.suffix").collect()}
    assert {k[1]: v for k, v in rows.items() if k[0] == "tree/a.py"}["string"] == '"lit"'
    assert [v for k, v in sorted(rows.items(), key=lambda x: x[0][2]) if k[0] == "tree/b.html"] == ["<p class='x'>", "hi", "<!-- no -->", " there", "</p>"]
    assert [r.kind for r in audit.spanned(spark.createDataFrame([(1, "a\0b"), (2, None), (3, "<!-- open")], "id int, t string"), "t", "'.html'").orderBy("id").collect()] == ["binary", "comment"]


def test_bytes_to_text(spark):
    rows = [(b"ok \xc3\xa9", "ok é"), (b"\xff\xfea", "��a"), (b"x\xed\xa0\x80y", "x���y"), (b"cut \xe4\xb8", "cut �"), (b"", ""), (None, "")]
    got = spark.createDataFrame([(k, d) for k, (d, _) in enumerate(rows)], "id int, d binary").select("id", from_bytes(F.col("d")).alias("t")).collect()
    assert {r.id: r.t for r in got} == {k: t for k, (_, t) in enumerate(rows)}


def test_rules_meet_packages_by_their_beginnings(spark):
    found = spark.createDataFrame([("f", p) for p in ["scikit-learn", "scikitlearn2", "os", "osmium", "num_py", "pandas-stubs"]], "rel_path string, package string")
    rules = spark.createDataFrame([("scikit_learn", "a"), ("os", "b"), ("numpy", "c"), ("pandas", "d"), ("pan", "e")], "rule string, level string")
    assert {(r.package, r.level) for r in audit.dependency_hits(found, rules).collect()} == {("scikit-learn", "a"), ("scikitlearn2", "a"), ("os", "b"), ("num_py", "c"), ("pandas-stubs", "d")}
