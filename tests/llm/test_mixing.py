import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veinstone.llm import mixing as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([1.0, 2.0, 5.0])), min_size=1, max_size=12), st.floats(0.1, 2.0))
def test_water_fill(sources, share):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    total = share * sum(sizes)
    made = M.water_fill(sizes, weights, total, 2.0)
    assert all(t <= 2 * s + 1e-6 for t, s in zip(made, sizes))
    assert sum(made) == pytest.approx(total, abs=1e-6)
    free = [t / w for t, w, s in zip(made, weights, sizes) if t < 2 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


def test_nothing_can_give_the_total():
    assert M.water_fill([3, 0], [1.0, 5.0], 100, 2.0) == [6.0, 0.0]


def test_mix(docs):
    rows = [(k, "w " * (k % 13), "en", ["a", "b", "é", None][k % 4]) for k in range(400)] + [(1000, None, "en", "a"), (1001, "", "en", "only empty"), (5, "w " * 5, "en", "b"), (None, "x y", "en", None)]
    out = M.mix_sources(docs(rows)).collect()
    assert len(out) == len(rows)
    assert out and sorted(map(tuple, out), key=str) == sorted(map(tuple, M.mix_sources(docs(rows)).collect()), key=str)
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 13
        assert all(r.taken <= 2 * r["size"] and r.taken == r.repeats * r["size"] for r in own)
    assert {r.target for r in out if r.source == "only empty"} == {0.0}
    mixed = M.repeat_documents(docs(rows).selectExpr("*", "1 AS target", "2 AS cut", "3 AS repeats", "4 AS size", "5 AS p_source")).collect()
    assert len(mixed) == sum(r.repeats for r in out)
    assert M.mix_sources(docs([])).collect() == [] and M.repeat_documents(docs([])).collect() == []


def test_hard_rows(docs, hard):
    assert len(M.mix_sources(docs(hard)).collect()) == len(hard)


@pytest.mark.parametrize("make", [lambda k: (None, f"a b c d e{k}"), lambda k: (7, f"a b c d e{k}"), lambda k: (7, "a b c d e"), lambda k: (None, "a b c d e"), lambda k: (k // 3, "a b c d e")])
def test_equal_ids_and_equal_rows_meet_the_target(docs, make):
    rows = [(*make(k), "en", "a") for k in range(1000)] + [(5000 + k, "x y z", "en", "b") for k in range(1500)]
    table = docs(rows).repartition(7)
    out = M.mix_sources(table, limit=10).collect()
    assert len(out) == len(rows)
    for source in "ab":
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5 and all(r.taken <= 2 * r["size"] for r in own)
    assert M.repeat_documents(table, limit=10).count() == sum(r.repeats for r in out)


def test_border_against_the_whole_order(docs):
    """Every document before the border is in, and the cut is where the running sum says."""
    rows = [(k, "w " * (k % 9 + 1), "en", "ab"[k % 2]) for k in range(500)]
    one, other = (sorted(map(tuple, M.mix_sources(docs(rows), limit=limit, digits=digits).collect())) for limit, digits in ((1, 1), (10_000, 3)))
    assert one == other


def test_clashing_names(docs):
    table = docs([(k, "a b", "en", "s") for k in range(10)]).selectExpr("*", "1 AS size", "2 AS key", "3 AS row", "4 AS repeats", "5 AS _size", "6 AS col", "7 AS cut", "8 AS number")
    out = M.repeat_documents(table)
    assert out.columns == table.columns and {(r["size"], r.key, r.row, r.repeats, r._size, r.col) for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}
