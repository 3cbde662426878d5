import random

import numpy as np
import pytest
import xxhash

from veinstone.llm import simhash as S


def brute_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    label = dict.fromkeys(fps)
    for f in fps:
        if label[f] is None:
            todo, label[f] = [f], f
            while todo:
                x = todo.pop()
                for y in fps:
                    if label[y] is None and (x ^ y).bit_count() <= radius:
                        label[y] = f
                        todo.append(y)
    return label


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("run", [2, 1024])
def test_links_join_what_brute_force_joins(radius, run, monkeypatch):
    monkeypatch.setattr(S, "PAIR_RUN", run)
    rng = random.Random(radius)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centers for _ in range(25)} | {0, 1, 3, 7, (1 << 64) - 1})
    visible, flips = (np.array(x, np.uint64) for x in zip(*S.masks(radius), strict=True))
    every = np.array(fps, np.uint64)
    keys = ((every[:, None] ^ flips) & visible).ravel()
    a, b = S.linked(keys, np.repeat(every, len(flips)), radius)
    label = brute_components(fps, radius)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[max(find(x), find(y))] = min(find(x), find(y))
    assert len({(find(f), label[f]) for f in fps}) == len({find(f) for f in fps}) == len(set(label.values()))


def test_masks():
    assert len(S.masks(3)) == 100 and len(S.masks(2)) == 65 and len(S.masks(0)) == 1


@pytest.mark.parametrize("n", [3, 5])
def test_query_against_brute_force(spark, docs, hard, n):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = list(hard)
    for k in range(100, 160):
        base = [rng.choice(words) for _ in range(200)]
        rows.append((k, " ".join(base)))
        for j in range(3):
            base[rng.randrange(200)] = "Changed"
            rows.append((k * 10 + j, "  ".join(base)))
    out = S.near_duplicates(docs(rows), n=n).collect()
    assert len(out) == len(rows)
    texts = {}
    for k, t in rows:
        texts.setdefault(brute_fingerprint(t, n), []).append(k)
    label = brute_components(list(texts), 3)
    smallest = {}
    for f, ids in texts.items():
        for k in ids:
            if k is not None:
                smallest[label[f]] = min(smallest.get(label[f], k), k)
    expected = sorted((-1 if k is None else k, f"{f:016x}", smallest.get(label[f], -1)) for f, ids in texts.items() for k in ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in out) == expected


@pytest.mark.parametrize("seed", range(2))
def test_one_of_each_group_stays(spark, docs, hard, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows, near = list(hard), {}
    for k in range(100, 130):
        base = [rng.choice(words) for _ in range(rng.choice([60, 120, 900]))]
        rows.append((k, " ".join(base)))
        near[k] = {k}
        for j in range(3):
            edited = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) // 80)):
                edited[at] = "Changed"
            rows.append((k * 10 + j, "  ".join(edited)))
        half = base[: len(base) // 2] + [rng.choice(words) for _ in range(len(base) // 2)]
        rows.append((k * 10 + 5, " ".join(half)))
        near[k * 10 + 5] = {k * 10 + 5}
    rows.append((100, rows[len(hard)][1]))
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in S.keep_one(docs(rows).selectExpr("*", "1 AS s", "2 AS fp", "3 AS hash", "4 AS root", "5 AS size")).collect())
    brute = sorted(near) + [-1, 1, 4, 5, 7, 8, 9]
    assert kept == sorted(brute)
    sets = {k: set(S.shingles(t.encode(), 5)) for k, t in rows if k in near or (k or 0) >= 1000}
    assert all(len(sets[k] & sets[k * 10 + j]) / len(sets[k] | sets[k * 10 + j]) >= 0.8 for k in range(100, 130) for j in range(3))


def test_views_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        # What differs is drawn at random, as hashes are.
        b = np.unique(np.r_[rng.permutation(a)[33:], rng.integers(0, 2**63, 33).astype(np.uint64)])
        met += bool((S.views(a) == S.views(b)).any())
        assert abs(S.similarity(a[: S.SKETCH], b[: S.SKETCH], S.SKETCH) - 0.8) < S.MARGIN
    assert met >= 97


def with_jaccard(rng, size, shared, words):
    """Two texts of `size` five-word shingles each, of which about `shared` are common."""
    base = [rng.choice(words) for _ in range(size + 4)]
    return base, base[: shared + 4] + [rng.choice(words) for _ in range(size - shared)]


def jaccard(a, b):
    a, b = (set(S.shingles(t.encode(), 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_long_texts_are_verified_by_all_shingles(docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, least = [], {}
    for k in range(80):
        a, b = with_jaccard(rng, 1000, 895 if k % 2 else 877, words)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        least[k] = jaccard(rows[-2][1], rows[-1][1])
    assert {least[k] >= 0.8 for k in least if k % 2} == {True} and {least[k] < 0.8 for k in least if k % 2 == 0} == {True}
    kept = {r.doc_id for r in S.keep_one(docs(rows)).collect()}
    assert {2 * k for k in least} <= kept
    assert {2 * k + 1 for k in least if k % 2 == 0} <= kept
    assert sum(2 * k + 1 in kept for k in least if k % 2) <= 2


def test_pairs_that_share_a_passage_with_thousands(docs):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(170)]
    rows = []
    for k in range(1500):
        own = [rng.choice(words) for _ in range(30)]
        other = own[: rng.choice([8, 12, 20])]
        other += [rng.choice(words) for _ in range(30 - len(other))]
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + other))]
    similar = {k for k in range(1500) if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8}
    cross = max(jaccard(rows[2 * k][1], rows[2 * j][1]) for k, j in (rng.sample(range(1500), 2) for _ in range(500)))
    assert len(similar) > 500 and cross < 0.8
    kept = {r.doc_id for r in S.keep_one(docs(rows)).collect()}
    # Of all pairs of texts only these are similar.
    assert kept == set(range(3000)) - {2 * k + 1 for k in similar}


def test_texts_of_one_template_stay(docs):
    """Fingerprints of these are near, by chains of hundreds, but no two texts are similar enough."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    template = [rng.choice(words) for _ in range(170)]
    rows = [(k, " ".join(template + [rng.choice(words) for _ in range(30)])) for k in range(4000)]
    assert max(jaccard(rows[k][1], rows[j][1]) for k, j in (rng.sample(range(4000), 2) for _ in range(500))) < 0.8
    assert S.keep_one(docs(rows)).count() == 4000


@pytest.mark.parametrize("run", [40, 1500])
def test_edges_are_near_pairs_that_join_all(run):
    rng = np.random.default_rng(run)
    base = rng.integers(0, 2**63, 3).astype(np.uint64)
    fps = np.unique(np.r_[base, np.array([base[rng.integers(3)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 30, 4).astype(np.uint64)) for _ in range(run)], np.uint64)])
    keys = np.zeros(len(fps), np.uint64)
    a, b = S.linked(keys, fps, 3, edges=True)
    assert (np.bitwise_count(a ^ b) <= 3).all() and len(a) < 4 * len(fps)
    u, v = S.linked(keys, fps, 3)
    forest, plain = S.Forest(len(fps)), S.Forest(len(fps))
    forest.link(np.searchsorted(fps, a), np.searchsorted(fps, b))
    plain.link(np.searchsorted(fps, u), np.searchsorted(fps, v))
    assert (forest.all_roots() == plain.all_roots()).all()


def test_prefixes_find_every_similar_pair():
    rng = np.random.default_rng(2)
    often = (np.arange(50, dtype=np.uint64), rng.integers(3, 100, 50))
    for _ in range(2000):
        a = np.unique(rng.integers(0, 200, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.92], rng.integers(0, 200, rng.integers(0, 5)).astype(np.uint64)])
        if len(b) and S.similarity(a, b) >= 0.8:
            x, y = sorted((a, b), key=len)
            index = S.prefixes(x, often, 0.8)[: len(x) - int(np.ceil(len(x) * (1.6 / 1.8) - 1e-9)) + 1]
            assert np.intersect1d(index, S.prefixes(y, often, 0.8)).size


def test_empty(docs):
    assert S.near_duplicates(docs([])).collect() == []
    assert S.keep_one(docs([])).collect() == []
