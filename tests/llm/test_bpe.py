"""Tree encoding against the library on texts whose borders are hard."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veinstone.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def small():
    """A codec whose leaves are so small that every border is joined."""
    old = bpe.TEXT_LEAF, bpe.PIECE_LEAF, bpe.NEAR
    bpe.TEXT_LEAF, bpe.PIECE_LEAF, bpe.NEAR = 5, 4, 2
    yield bpe.Codec(RANKS, P.PATTERN)
    bpe.TEXT_LEAF, bpe.PIECE_LEAF, bpe.NEAR = old


def check(codec, text):
    ids = codec.encode(text)
    assert ids.tolist() == codec.library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


HARD = ["", " ", "a", "  \n\n  ", "it're we'll don't 'sss ''' 'l 'll", "a" * 300, "ab" * 200, " " * 100 + "x", "x" + "\n " * 60 + "y", "été ß 日本語テキスト🙂🙂 2024 12345678", "'re've'd's" * 20, "aaa bbb\t\tccc  ddd\r\n\r\neee"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(small, text):
    check(small, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab'srelv \n\t1é.,🙂", max_size=80))
def test_any_text(small, text):
    check(small, text)


def test_long_texts_with_real_leaves():
    codec, rng = bpe.Codec(RANKS, P.PATTERN), random.Random(5)
    words = ["tion", "the", "'re", "élan", "  ", "\n\n", "x" * 700, "12345", "!?", "über"]
    for sep in ("", " "):
        check(codec, sep.join(rng.choice(words) for _ in range(9000)))
    check(codec, "letters" * 6000)


def test_any_bracketing_joins_alike():
    codec = bpe.Codec(RANKS, P.PATTERN)
    data = "unbelievablyconcatenatedwordswithoutspaces".encode() * 3
    whole = codec.piece(data)
    for cut in range(1, len(data)):
        assert codec.join_pieces(codec.piece(data[:cut]), codec.piece(data[cut:])) == whole


def test_decode_concatenates(monkeypatch):
    monkeypatch.setattr(bpe, "ID_LEAF", 3)
    codec = bpe.Codec(RANKS, P.PATTERN)
    ids = np.array(codec.library.encode_ordinary("some text, été and more of it"), np.uint32)
    assert codec.decode(ids) == "some text, été and more of it".encode()


def test_documents(docs, hard):
    library = bpe.Codec(RANKS, P.PATTERN).library
    table = docs(hard).selectExpr("*", "'clash' AS ids", "1 AS decoded")
    both = bpe.round_trip(table, RANKS, P.PATTERN).collect()
    apart = bpe.decode_documents(bpe.encode_documents(table, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    for rows in (both, apart):
        assert sorted((r.doc_id or -1, r.text or "", bytes(r.ids)) for r in rows) == sorted((k or -1, t or "", np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for k, t in hard)
        assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.round_trip(docs([]), RANKS, P.PATTERN).collect() == []
