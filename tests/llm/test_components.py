import random

import pytest

from veinstone.llm.components import connected_components


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


def chain(n):
    return [(k, k + 1) for k in range(n)]


@pytest.mark.parametrize("links", [chain(60), [(0, k) for k in range(1, 400)], [(k, 10_000 - k) for k in range(50)] + chain(5), [(-5, 7), (7, 2**62), (3, 3)]])
def test_components(spark, links):
    random.Random(1).shuffle(links)
    rows = [*links, (None, 1), (2, None)]
    out = connected_components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == brute([(a, b) for a, b in links if a != b])
    assert len(out) == len({r.node for r in out})


def test_random(spark):
    rng = random.Random(3)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    links = [(a, b) for a, b in links if a != b]
    out = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == brute(links)


def test_none(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
