import pytest


@pytest.fixture
def docs(spark):
    """docs(rows): a documents table of (doc_id, text[, lang[, source]]) rows."""

    def make(rows, extra=""):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


#: Nulls, empty and blank texts, one letter, ties, repeated rows and a long text.
HARD = [(None, "a null id stays"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "same words here\nand here\nand there\nend"), (5, "same words here\nand here\nand there\nend"), (6, "same words here\nand here\nand there\nend"), (7, "long word " * 30000), (8, "é" * 5000), (9, "tab\tseparated\r\nlines\x0bhere\x1cend <|endoftext|> x")]


@pytest.fixture
def hard():
    return HARD
