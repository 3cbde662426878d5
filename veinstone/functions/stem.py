"""English stems by Porter's published algorithm (1980), for the stemmed body field."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import is_cjk, normalize

_DOUBLE = re.compile(r"([^aeioulsz])\1$")

# Suffixes and what stands for them.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v and c for vowels and consonants."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    for end in sorted((e for e in table if word.endswith(e)), key=len, reverse=True)[:1]:
        head = word[: -len(end)]
        return head + table[end] if _measure(head) >= least else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters and less, or with other than a to z, are left alone."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    word = _swap(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, 0)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _DOUBLE.search(word) and _shape(word)[-1] == "c":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2, 1), STEP_3, 1)
    end = max((e for e in STEP_4 if word.endswith(e)), key=len, default="")
    head = word[: -len(end)] if end else word
    if end and _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
        word = head
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _text_stems(rows: pd.Series) -> pd.Series:
    return rows.map(lambda t: [stem(w) for w in re.findall(r"[^\W_]+", normalize(t or "").lower()) if not any(map(is_cjk, w))])


def text_stems(text: Column) -> Column:
    """Stems of a text's words, in one call; for queries."""
    return F.pandas_udf(_text_stems, "array<string>")(text)


def may_have(word: Column, stems: list[str]) -> Column:
    """Whether a word may have one of these stems: true for all that have one, and for few others.

    A stem has the first letter of its words, and all its letters but the last two are theirs: a step puts new letters only at
    the end, two at most (-bility to -ble), and later steps only take letters off. Four letters are compared at most.
    """
    heads = {s[: min(4, max(1, len(s) - 2))] for s in stems}
    found = F.lit(False)
    for n in sorted({len(h) for h in heads}):
        found = found | F.substring(word, 1, n).isin(*sorted(h for h in heads if len(h) == n))
    return found
