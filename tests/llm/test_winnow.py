import hashlib
import random
import re

import numpy as np
import pytest

from veinstone.llm import winnow as N

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    windows = [(i, w[k : k + min(len(w), size)]) for i, w in ((i, words(t)) for i, t in items) for k in range(len(w) - min(len(w), size) + 1 if w else 0)]
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item, win in windows:
            for k in range(len(own) - len(win) + 1):
                if own[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
        found = sorted(str(i) for i in found if i is not None)
        out.append((str(doc_id), len(own), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, key string, n_words long"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, class string")


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.mark.parametrize("size,gram", [(10, 5), (4, 2), (3, 3), (1, 1)])
def test_against_brute_force(spark, size, gram):
    rng = random.Random(size)
    vocabulary = ["alpha", "Beta", "gämma", "δέλτα", "x1", "it's", "中文"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(0, 14))) for k in range(25)] + [(3, "alpha beta"), (99, None), (100, ""), (None, "beta beta beta beta")]
    docs = [(k, say(rng.randint(0, 40)) + ", " + rng.choice(items[:25])[1].upper().replace("Δ", "δ").replace("Έ", "έ").replace("Λ", "λ").replace("Τ", "τ").replace("Α", "α").replace("Ä", "ä") + ".\n" + say(rng.randint(0, 9))) for k in range(60)]
    docs += [(5, docs[5][1]), (5, "alpha beta"), (None, docs[6][1]), (200, None), (201, ""), (202, " ;; ")]
    a, b = tables(spark, docs, items)
    assert got(N.decontaminate(a.repartition(5), b, words=size, gram=gram)) == brute(docs, items, size)


def test_every_shared_span_has_a_fingerprint():
    rng = random.Random(1)
    for _ in range(50):
        span = [b"w%d" % rng.randrange(30) for _ in range(10)]
        left, right = ([b"v%d" % rng.randrange(9) for _ in range(rng.randrange(12))] for _ in range(2))
        own = N.leading(left + span + right, 10, 5)
        assert N.leading(span, 10, 5)[0] == own[len(left)]


def test_fingerprints_are_sparse():
    own = [b"w%d" % k for k in range(20_000)]
    assert len(np.unique(N.leading(own, 10, 5))) < 0.33 * len(own)


def test_filter_has_all_fingerprints(spark):
    fps = [0, 1, -1, N.FILTER_BITS - 1, N.FILTER_BITS, 7**20 % 2**63, -(7**20 % 2**63)]
    bits = N.fingerprint_filter(spark.createDataFrame([(f,) for f in fps], "fp long"))
    on = {f % N.FILTER_BITS for f in fps}
    assert {k for k in np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()} == on


def test_spans(spark):
    a, b = tables(spark, [(1, "x one two three y one two three four two three four z")], [(1, "one two three"), (2, "two three four")])
    assert [(s.start, s.stop) for s in N.decontaminate(a, b, words=3, gram=2).first().spans] == [(1, 4), (5, 12)]


def test_many_copies_and_items(spark):
    """A passage that a third of the documents share with every item, and copies of one text."""
    passage = " ".join(f"p{k}" for k in range(12))
    docs = [(k, f"d{k} {passage} e{k}") for k in range(300)] + [(1000 + k, f"same {passage}") for k in range(300)] + [(5000 + k, f"clean text number {k}") for k in range(300)]
    items = [(k, f"{passage} i{k}") for k in range(40)]
    a, b = tables(spark, docs, items)
    assert got(N.decontaminate(a, b)) == brute(docs, items, 10)


def test_empty_tables_and_hard_rows(spark, hard):
    docs, items = [(1, "one two")], [(1, "one")]
    a, b = tables(spark, docs, items)
    none_a, none_b = tables(spark, [], [])
    assert got(N.decontaminate(none_a, b)) == []
    assert got(N.decontaminate(a, none_b)) == brute(docs, [], 10)
    a, b = tables(spark, hard, [(1, "same words here and here and there end"), (2, "long word long")])
    assert got(N.decontaminate(a, b)) == brute(hard, [(1, "same words here and here and there end"), (2, "long word long")], 10)
