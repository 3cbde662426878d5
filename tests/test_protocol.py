"""Errors worth another attempt, tool calls, messages, placeholder titles, validators, the status line."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from veinstone.functions import text
from veinstone.operators import toolcalls, validation
from veinstone.plans import models
from veinstone.plans.ask import State
from veinstone.sources import retry


def failing(words="", **fields):
    error = RuntimeError(words)
    for name, value in fields.items():
        setattr(error, name, value)
    return error


@pytest.mark.parametrize(
    ("error", "again"),
    [
        (failing(status_code=429), True),
        (failing(status=529), True),
        (failing("timeout", http_status=400), False),
        (failing("Rate limit, try again"), True),
        (failing("insufficient_quota: rate limit"), False),
        (ConnectionResetError("by peer"), True),
        (TimeoutError(), True),
        (failing("status text", status="503"), False),
        (ValueError("odd"), False),
        (models.TransientError("unsupported"), True),
    ],
)
def test_errors_worth_another_attempt(error, again):
    assert retry.worth_another(error) is again


def test_waits_double_up_to_a_bound():
    assert list(itertools.islice(retry.waits(1, 5, 0), 4)) == [1, 2, 4, 5]
    assert all(0.75 <= next(retry.waits(1, 5)) <= 1.25 for _ in range(100))
    waits, calls = [], []

    def busy(prompts):
        calls.append(1)
        raise failing("overloaded")

    assert models.with_retries(busy, 3, 1, waits.append)(["a", "b"]) == [models.Response(None, error="RuntimeError: overloaded")] * 2
    assert len(calls) == 3 and len(waits) == 2
    assert models.with_retries(busy, 1, 1, waits.append)(["a"])[0].error and len(waits) == 2


def test_tool_calls(spark):
    wrapped = {"id": "a", "function": {"name": "search", "arguments": '{"k": 1}'}}
    replies = [[wrapped, {"function": {"name": "gather", "arguments": "["}}, {"id": "7", "name": "reset", "arguments": {"x": 1}}, {"name": "finish"}], [{"function": {"name": "f", "arguments": '{"query": "salt",}'}}, {"function": {"name": "g", "arguments": "[1, 2]"}}], None, []]
    rows = spark.createDataFrame([(k, json.dumps({"tool_calls": r})) for k, r in enumerate(replies)] + [(9, "no json"), (10, None)], "id int, reply string")
    each = rows.select("id", F.explode(toolcalls.calls(F.col("reply"))).alias("c")).select("id", F.col("c.id").alias("call"), "c.name", toolcalls.read(F.col("c.raw")).alias("r"))
    out = [(r.id, r.call, r.name, json.loads(r.r.arguments), r.r.unread) for r in each.collect()]
    assert out == [(0, "a", "search", {"k": 1}, None), (0, "call-1", "gather", {}, "["), (0, "7", "reset", {"x": 1}, None), (0, "call-3", "finish", {}, None), (1, "call-0", "f", {"query": "salt"}, None), (1, "call-1", "g", {"value": [1, 2]}, None)]


def test_placeholder_titles_and_key_stems(spark):
    rows = [("Untitled-3", "x"), ("draft.TEX", "x"), (" Document ", "x"), ("Salt2020", "salt2020"), ("Salt and water", "x"), (None, "x"), ("Documents", None)]
    got = spark.createDataFrame(rows, "t string, s string").select(text.is_placeholder_title(F.col("t"), F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == [True, True, True, True, False, False, False]
    stems = [("Meyer2021Salt",), ("Mey2021",), ("12345678",), ("Meyer 2021 Salt",), (None,), ("盐与水的研究方法2020",)]
    got = spark.createDataFrame(stems, "s string").select(text.is_key_stem(F.col("s")).alias("k")).collect()
    assert [r.k for r in got] == [True, False, False, False, False, True]


def test_validators(spark):
    rows = [(1, " a ", 1, 1, 5), (2, " ​\n", 1, 1, 0), (3, "b", 0, None, -1), (4, None, None, None, None)]
    good, bad = validation.split(spark.createDataFrame(rows, "id int, text string, page_start int, page_end int, char_count int"), "fragment")
    assert [r.id for r in good.collect()] == [1] and good.columns[0] == "id" and "faults" not in good.columns
    assert {r.id: r.faults for r in bad.collect()} == {2: ["text"], 3: ["page_start", "char_count"], 4: ["text"]}
    tiers = spark.createDataFrame([(k, "t") for k in (-1, 0, 3, 4, None)], "quality_tier int, title string")
    assert {r.quality_tier for r in validation.split(tiers, "source")[0].collect()} == {0, 3, None}
    assert [r.question for r in validation.split(spark.createDataFrame([(" ",), ("why",)], "question string"), "session")[0].collect()] == ["why"]


def test_cleaned(spark):
    row = spark.createDataFrame([(" A　 title ", "  ", ["x ", " "], "https://doi.org/10.1/AB")], "title string, venue string, authors array<string>, doi string")
    assert tuple(validation.cleaned(row).first()) == ("A title", None, ["x"], "10.1/ab")
    assert validation.cleaned(spark.createDataFrame([([" "],), (None,)], "authors array<string>")).collect() == [(None,), (None,)]


def test_status_line():
    state = State("why", evidence={"a": {}, "b": {}})
    assert state.line(9) == "all of 9 sources in scope; 2 pieces of evidence; spent 0.0000 USD"
    state.in_scope = 3
    assert state.line(9, 0.12345, "EUR") == "3 of 9 sources in scope; 2 pieces of evidence; spent 0.1235 EUR"
