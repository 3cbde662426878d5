"""Near-dedup of a large group of near copies: few pairs are judged, and none that counts is lost."""

import random

from veinstone.llm import simhash


def test_large_group_is_joined_at_its_hub(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**9)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        words = list(base)
        for at in draw.sample(range(150), 3):
            words[at] = f"x{draw.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made, write = {}, simhash.written

    def counted(df, label, keep=False):
        out = write(df, label, keep)
        made[label] = made.get(label, 0) + (out.count() if label in ("pairs", "hubs") else 0)
        return out

    monkeypatch.setattr(simhash, "written", counted)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    sets = [{tuple(text.split()[k : k + 5]) for k in range(146)} for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert kept == {find(k) for k in range(len(rows))}
    assert made["pairs"] + made.get("hubs", 0) <= 4 * len(rows), made
