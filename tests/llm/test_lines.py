import random

import numpy as np
import pytest

from veinstone.llm import lines as L


def brute(rows, window=3):
    """doc_id to (text, removed); rows with one id and text are one document."""
    unique = sorted({(k is None, k or 0, t) for k, t in rows if t is not None})
    seen, out = set(), {}
    for none, k, t in unique:
        parts = t.split("\n")
        full = [i for i, x in enumerate(parts) if x.strip(L.BLANKS)]
        gone = set()
        own = [tuple(parts[i].strip(L.BLANKS) for i in full[j : j + window]) for j in range(len(full) - window + 1)]
        for j, w in enumerate(own):
            if w in seen:
                gone.update(range(j, j + window))
            seen.add(w)
        cut = {full[j] for j in gone} | {i for j in gone if j + 1 in gone for i in range(full[j], full[j + 1])}
        out[None if none else k, t] = ("\n".join(x for i, x in enumerate(parts) if i not in cut), len(gone))
    return out


def test_against_brute_force(docs):
    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice(["aa", "bb", "cc", "dd", "", " ", "aa\r", str(rng.random())]) for _ in range(rng.randint(0, 14)))) for k in range(150)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (500, None)]
    # Ties of one doc_id go by a hash of the text; here ids are distinct but for the repeated row.
    out = L.dedup_lines(docs(rows).selectExpr("*", "7 AS lines_removed", "1 AS covered", "2 AS at", "3 AS first", "4 AS c_text")).collect()
    expected = brute(rows)
    assert len(out) == len(rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.lines_removed) for r in out)
    assert got == sorted((k if k is not None else -1, *(expected[k, t] if t is not None else ("", 0))) for k, t in rows)


@pytest.mark.parametrize(("text", "covered", "expected"), [("a\n\nb\nc\nd", [0], ("d", 3)), ("a\nb\nc\nd\ne", [1, 2], ("a", 4)), ("x\n\na\nb\nc\n\ny", [1], ("x\n\n\ny", 3))])
def test_cut(text, covered, expected):
    assert L.cut_lines(text, np.array(covered), 3) == expected


def test_hard_rows(docs, hard):
    out = L.dedup_lines(docs(hard)).collect()
    assert len(out) == len(hard)
    assert [r.text for r in out if r.doc_id == 6] == [""]
    assert {r.text for r in out if r.doc_id == 5} == {hard[5][1]}
    assert L.dedup_lines(docs([])).collect() == []


def test_clashing_names(docs):
    rows = [(k, "a\nb\nc\nd") for k in range(3)]
    table = docs(rows).selectExpr("*", "'t' AS _text", "1 AS _covered", "2 AS covered", "3 AS row", "4 AS cut", "5 AS hit", "true AS _doc_null", "6 AS c_doc")
    out = L.dedup_lines(table)
    assert out.columns == [*table.columns, "lines_removed"]
    assert {(r._text, r._covered, r.covered, r.row, r.cut, r.hit, r._doc_null, r.c_doc) for r in out.collect()} == {("t", 1, 2, 3, 4, 5, True, 6)}
