import itertools

import pytest
from pyspark.sql import functions as F

from veinstone.functions.stem import STEP_2, STEP_3, STEP_4, may_have, stem

# Examples of the published algorithm.
CASES = dict(caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor", sing="sing", conflated="conflat", troubled="troubl", sized="size", hopping="hop", falling="fall", hissing="hiss", failing="fail", filing="file", happy="happi", sky="sky", relational="relat", conditional="condit", rational="ration", digitizer="digit", operator="oper", feudalism="feudal", decisiveness="decis", hopefulness="hope", formality="formal", triplicate="triplic", formalize="formal", electrical="electr", goodness="good", revival="reviv", adjustable="adjust", effective="effect", probate="probat", rate="rate", cease="ceas", controlling="control", roll="roll", adoption="adopt", été="été", x1="x1")


@pytest.mark.parametrize(("word", "expected"), CASES.items())
def test_stem(word, expected):
    assert stem(word) == expected


def test_stems_keep_the_letters_of_their_words():
    ends = ["", *STEP_2, *STEP_3, *STEP_4, "s", "sses", "ies", "eed", "ed", "ing", "y", "e", "ly", "bility", "ll"]
    words = ["".join(w) for w in itertools.product(["", "a", "b", "tr", "rel", "oper", "hop", "siz", "y"], ends, ends)]
    assert all(w.startswith(stem(w)[: max(1, len(stem(w)) - 2)]) for w in words if w)


def test_words_that_may_have_a_stem(spark):
    words = [*CASES, "x", "été", "versions", "ver"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    for stems in (["oper", "happi"], ["x1"], ["été", "ti"]):
        found = {r.w for r in rows.where(may_have(F.col("w"), stems)).collect()}
        assert {w for w in words if stem(w) in stems} <= found and "ver" not in found
    assert rows.where(may_have(F.col("w"), [])).count() == 0
