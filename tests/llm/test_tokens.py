import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veinstone.llm import tokens

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_round_trip(values):
    made = np.array(values, np.uint64)
    assert np.array_equal(tokens.unpack(tokens.pack(made)), made)


@pytest.mark.parametrize("bits", [1, 2, 3, 7, 15, 16, 20, 30, 31, 59, 60, 61, 64])
def test_widths(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 2**bits, 5000, dtype=np.uint64) if bits < 64 else rng.integers(0, 2**64, 5000, dtype=np.uint64)
    assert np.array_equal(tokens.unpack(tokens.pack(values)), values)


def test_narrow_values_take_few_words():
    assert len(tokens.pack(np.ones(6000, np.uint64))) < 16 + 6 * 8 + 8 * 120


def test_broken_stream():
    with pytest.raises(ValueError):
        tokens.unpack(b"nothing of the kind")


def test_words_as_whole_texts(hard):
    library = Tokenizer.from_file(PATH)
    own = tokens.WordTokenizer(open(PATH, encoding="utf-8").read())
    own.CACHED = 50
    texts = [t or "" for _, t in hard] + ["Don't  STOP\n\n'll it’s 12 34é", "日本語 テキスト　全角 é", "<|startoftext|>a <|endoftext|>", "İstanbul ΑΣ Σ"]
    for _ in range(2):
        for text, made in zip(texts, own.encode(texts), strict=True):
            assert made.tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_files(docs, hard):
    library = Tokenizer.from_file(PATH)
    rows = [r for r in hard if r[0] is not None]
    got = tokens.read_ids(tokens.write_ids(docs(hard), open(PATH, encoding="utf-8").read())).collect()
    assert len(got) == len(hard)
    first = [r for r in got if r.doc_id is None]
    assert len(first) == 1 and first[0].start == 0
    at, ordered = first[0].n_tokens, sorted((r for r in got if r.doc_id is not None), key=lambda r: r.start)
    for row, (doc_id, text) in zip(ordered, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, at, len(ids))
        assert zlib.crc32(row.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(docs):
    assert tokens.read_ids(tokens.write_ids(docs([]), open(PATH, encoding="utf-8").read())).collect() == []
