import math
import random
from collections import Counter

import numpy as np
import pytest

from veinstone.llm import quality as Q


def brute(texts, scored, order=Q.ORDER):
    """Perplexities by plain dictionaries."""
    symbols = lambda t: [0] * (order - 1) + [int(x) + 1 for x in Q.fold(t)]
    windows = lambda t: [tuple(s[i : i + order]) for s in [symbols(t)] for i in range(len(s) - order + 1)]
    grams = {order: Counter(w for t in texts if t for w in windows(t))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def discount(k):
        n = Counter(grams[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        return lambda c: min(max(min(c, 3) - (min(c, 3) + 1) * y * (n[min(c, 3) + 1] / n[min(c, 3)] if n[min(c, 3)] else 0), 0), min(c, 3))

    d = {k: discount(k) for k in grams}
    total, freed = Counter(), Counter()
    for k in grams:
        for g, c in grams[k].items():
            total[k, g[:-1]] += c
            freed[k, g[:-1]] += d[k](c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(grams[1]) + 1)
        if (k, g[:-1]) not in total:
            return p(g[1:])
        c = grams[k].get(g, 0)
        return ((c - d[k](c)) if c else 0) / total[k, g[:-1]] + max(freed[k, g[:-1]] / total[k, g[:-1]], Q.LEAST_SHARE) * p(g[1:])

    return [2 ** -np.mean([math.log2(p(w)) for w in windows(t)]) if t else None for t in scored]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, lang string")


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_against_dictionaries(spark, docs, order, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_ROWS", 17)
    monkeypatch.setattr(Q, "CHUNK", 900)
    rng = random.Random(1)
    words = ["tion", "the", "and", "été", "or", "Not", "12", "x?"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), "a" if k % 2 else "b") for k in range(120)]
    rows += [(200, "#$%&" * 20, "a"), (201, None, "a"), (202, "", "b"), (203, "zzz", None), (None, "the and", "b"), (5, rows[5][1], "b")]
    good = [(k, 1, 0, "clash", "q") for k in range(0, 120)] + [(3, 0, 0, "", ""), (7, 1, 1, "", ""), (None, 1, 0, "", ""), (999, 1, 0, "", "")]
    table = docs(rows)
    out = Q.classify(table.repartition(3), labels(spark, good), least=5, order=order).collect()
    assert len(out) == len(rows)
    trusted = [t for k, t, _ in rows if k is not None and k < 120 and (k, 1, 0, "clash", "q") in good]
    expected = dict(zip([t for _, t, _ in rows], brute(trusted, [t or "" for _, t, _ in rows], order)))
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    for k, t, _ in rows:
        assert by[k].perplexity == (pytest.approx(expected[t], rel=1e-4) if t else None), t
    assert (order == 1 or not by[200].kept) and not by[201].kept and not by[202].kept
    assert np.mean([by[k].kept for k in range(120)]) > 0.95


def test_nothing_trusted_and_empty(spark, docs, hard):
    assert all(r.perplexity is None and not r.kept for r in Q.classify(docs(hard), labels(spark, [])).collect())
    assert Q.classify(docs([]), labels(spark, [(1, 1, 0, "", "")])).collect() == []


def test_hard_rows(spark, docs, hard):
    out = Q.classify(docs(hard), labels(spark, [(7, 1, 0, "", ""), (5, 1, 0, "", "")])).collect()
    assert len(out) == len(hard)
    assert {r.doc_id for r in out if r.perplexity is None} == {1, 2}


def test_thresholds_from_a_held_out_part(spark, docs):
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkqjxz", range(52, 0, -2), k=rng.randint(2, 7))) for _ in range(60)] + ["\U0001f600", "漢字"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))), "a" if k % 3 else "b") for k in range(90)]
    rows += [(100 + k, "".join(chr(rng.randint(97, 122)) for _ in range(rng.randint(1, 60))), "ab"[k % 2]) for k in range(20)] + [(300, "the or", None), (301, "", "a")]
    held = {r.t for r in spark.range(90).selectExpr("id AS t").where("pmod(xxhash64(t), 3) = 0").collect()}
    trusted = {k: t for k, t, _ in rows if k < 90}
    learned = [t for k, t in trusted.items() if k not in held]
    perplexity = brute(learned, [t for _, t, _ in rows])
    bits = [math.log2(p) * len(t) if p else 0.0 for p, (_, t, _) in zip(perplexity, rows)]
    judges = [i for i, (k, _, _) in enumerate(rows) if k in held]
    mean = sum(bits[i] for i in judges) / sum(len(rows[i][1]) for i in judges)
    rate = [(b + 32 * mean) / (len(t) + 32) if t else None for b, (_, t, _) in zip(bits, rows)]

    def cut(of):
        ordered = sorted(rate[i] for i in of)
        return ordered[max(math.ceil(0.9 * len(ordered)) - 1, 0)]

    by_lang = {x: cut([i for i in judges if rows[i][2] == x]) for x in "ab"}
    out = {r.doc_id: r for r in Q.classify(docs(rows), labels(spark, [(k, 1, 0, "", "") for k in range(90)]), quantile=0.9, least=2, folds=3).collect()}
    assert len(out) == len(rows) and 10 < len(held) < 60
    for i, (k, t, lang) in enumerate(rows):
        limit = by_lang.get(lang, cut(judges))
        assert out[k].threshold == pytest.approx(1.1 * 2**limit, rel=1e-4), k
        assert out[k].perplexity == (pytest.approx(perplexity[i], rel=1e-4) if t else None), k
        if not t or abs(rate[i] - limit - math.log2(1.1)) > 1e-4:
            assert out[k].kept == bool(t and rate[i] <= limit + math.log2(1.1)), k
    assert sum(out[k].kept for k in range(90)) > 80 and not any(out[100 + k].kept for k in range(20) if len(rows[90 + k][1]) > 20)


def test_nothing_left_to_hold_out(spark, docs):
    table, good = docs([(k, "the and or " * 9, "a") for k in range(3)]), labels(spark, [(0, 1, 0, "", "")])
    for folds in (1, 2, 10**9):
        out = Q.classify(table, good, folds=folds).collect()
        assert len(out) == 3 and len({(r.perplexity, r.kept) for r in out}) == 1


def test_counts_are_packed_and_summed():
    texts = ["abcabc", "", "bca", "ab" * 500, "\U0001f600é"]
    rng = np.random.default_rng(1)
    value = {}
    of = lambda h: value.setdefault(h, tuple(rng.normal(size=2)))
    expected = np.zeros(len(texts))
    for d, t in enumerate(texts):
        if t:
            seq = Q.symbols(t, 3)
            for k in (1, 2, 3):
                own = Q.hashes(seq[3 - k :], k).tolist()
                assert len(own) == len(t)
                expected[d] += sum(of(h)[0] for h in own) + sum(of(h)[1] for h in own[:-1])
    keys = np.array(sorted(value), np.uint64)
    gain, share = np.array([value[int(h)] for h in keys]).T
    got = np.zeros(len(texts))
    for shard, *data in Q.packed_shards(texts, 3, 7):
        assert all(int(h) * 7 >> 64 == shard or (int(h) >> 32) * 7 >> 32 == shard for h in np.frombuffer(data[0], np.uint64))
        docs, sums = Q.block_sums(keys, gain, share, *data)
        got[docs] += sums
    assert got == pytest.approx(expected)


def test_the_model_grows_with_the_alphabet(spark):
    counts = Q.ngram_counts(spark.createDataFrame([("".join(map(chr, range(0x4E00, 0x4E00 + 5000))),)], "text string"))
    assert counts.count() == 5000 and Q.kneser_ney(counts).values.count() > 10_000
