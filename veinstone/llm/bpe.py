"""Byte-level BPE encoding and decoding by tree reduction.

A text is halved until its parts are short; the parts are encoded, and neighbours are joined upwards.
Encodings with this join are a monoid: any bracketing gives the tokens of the whole text, so parts can
be encoded anywhere and joined in any order of neighbours.

Joining two texts: the pattern cuts a text into pieces, and a piece of the left text is certain if it
was decided without looking past the left text's end. From the first uncertain piece on, the window of
pieces is cut anew over the border, and grows until one of its cuts falls on a cut of the right text;
from there on the pattern sees what it saw before, so all later tokens stand. At a letter, space,
letter no window is needed, and halves are cut there where they can be.

Joining two parts of one long piece: the window over the border is encoded anew, and grows on a side
until its outer token and the next token outside encode to themselves when put together. A sequence of
tokens is the encoding of its bytes if all its neighbours do so; so the tokens outside stand.

Decoding concatenates up the same kind of tree. Null texts count as empty, and empty texts have no
tokens. Very long texts and pieces are halved like any other, in memory linear in their length. Repeated rows are
encoded alike; other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import released, small_batches

#: Characters (of a text), bytes (of a piece) and ids that are encoded or decoded at once.
TEXT_LEAF, PIECE_LEAF, ID_LEAF = 512, 512, 4096
#: How far from the middle a border of a word is looked for.
NEAR = 64
BORDER = regex.compile(r"\p{L}(?= \p{L})")
#: What makes a border of a word one of the pattern: runs of letters with one blank before them, and no longer look-ahead than a sign behind blanks.
WORDS, BLANKS = r" ?\p{L}+", r"\s+(?!\S)"
#: The longest alternative of the pattern that needs characters behind its end; the last pieces that hold so many characters are uncertain.
LOOKAHEAD = 3


class Codec:
    """Ranks and pattern, with the tree encoder."""

    def __init__(self, ranks: bytes, pattern: str):
        if not {WORDS, BLANKS} <= set(pattern.split("|")):
            raise ValueError("the borders and look-ahead here hold for patterns with these alternatives only")
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.compatible = lru_cache(100_000)(self._compatible)

    # Pieces

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if len(data) <= PIECE_LEAF:
            return self.library._core_bpe.encode_single_piece(data)
        middle = len(data) // 2
        return self.join_pieces(self.piece(data[:middle]), self.piece(data[middle:]))

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)

    def _compatible(self, a: int, b: int) -> bool:
        return self.library._core_bpe.encode_single_piece(self.bytes_of([a, b])) == [a, b]

    def join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two adjacent parts of a piece, from the tokens of each."""
        if not left or not right:
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.library._core_bpe.encode_single_piece(self.bytes_of(left[len(left) - i :] + right[:j]))
            grow_left = i < len(left) and not self.compatible(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.compatible(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * 2 if grow_left else i, j * 2 if grow_right else j

    # Texts

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as the library's encode_ordinary gives them."""
        ids, _ = self._encode(text, 0, len(text))
        return ids

    def _leaf(self, text: str) -> np.ndarray:
        if len(text) > PIECE_LEAF and max((m.end() - m.start() for m in self.pattern.finditer(text)), default=0) > PIECE_LEAF:
            return self._pieces(self.pattern.findall(text))
        return np.array(self.library.encode_ordinary(text), np.uint32)

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        return np.array([t for p in pieces for t in self.piece(p.encode())], np.uint32)

    def _encode(self, text: str, start: int, end: int) -> tuple[np.ndarray, int]:
        """Ids of text[start:end], and the start of a piece in its last part."""
        if end - start <= TEXT_LEAF:
            return self._leaf(text[start:end]), start
        middle = (start + end) // 2
        near = BORDER.search(text, middle - NEAR, middle + NEAR)
        cut = near.end() if near else middle
        left, anchor = self._encode(text, start, cut)
        right, anchor_right = self._encode(text, cut, end)
        if near:
            return np.concatenate([left, right]), anchor_right
        return self.join(text, left, anchor, cut, right, anchor_right, end)

    def join(self, text: str, left: np.ndarray, anchor: int, cut: int, right: np.ndarray, anchor_right: int, end: int) -> tuple[np.ndarray, int]:
        """Ids of two adjacent texts that meet at `cut`; `anchor` is the start of a piece of the left one."""
        first, redone = cut, []
        for m in self.pattern.finditer(text, anchor, cut):
            if max(m.start() + LOOKAHEAD, m.end() + LOOKAHEAD - 1) > cut:
                first = min(first, m.start())
                redone.append(m.group())
        drop_left = len(self._pieces(redone))
        window, dropped = [], []
        theirs = self.pattern.finditer(text, cut, end)
        at_right, at = cut, first
        for m in self.pattern.finditer(text, first, end):
            window.append(m.group())
            at = m.end()
            while at_right < at:
                piece = next(theirs)
                dropped.append(piece.group())
                at_right = piece.end()
            if at >= cut and at_right == at:
                break
        ids = np.concatenate([left[: len(left) - drop_left], self._pieces(window), right[len(self._pieces(dropped)) :]])
        return ids, max(anchor_right, first) if at <= anchor_right else first

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        if len(ids) <= ID_LEAF:
            return self.library.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_codecs: dict[tuple[int, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec in each Python worker."""
    key = (hash(ranks), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def read_ranks(path: str) -> bytes:
    """The rank file; the driver reads it once (about a megabyte) and sends it to the executors."""
    with open(path, "rb") as f:
        return f.read()


#: Bytes of one batch that goes back to Spark.
BATCH = 4_000_000


def _mapped(df: DataFrame, column: str, make: Callable[[], Callable[[object], tuple[bytes, ...]]], out: tuple[str, ...]) -> DataFrame:
    """`df` with binary columns `out` made from `column` value by value, in batches of bounded size."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in out]
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            begin, made, size = 0, [], 0
            for k, value in enumerate(batch.column(at), start=1):
                made.append(own(value.as_py()))
                size += sum(map(len, made[-1]))
                if size >= BATCH or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, k - begin).columns, *[pa.array(c, pa.binary()) for c in zip(*made, strict=True)]], names=[*names, *out])
                    begin, made, size = k, [], 0

    schema = df.select(*names).schema
    for c in out:
        schema = schema.add(c, "binary")
    return df.select(*names).mapInArrow(released(run), schema)


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with `out`: the ids of each text as little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = codec(sent.value, pattern)
        return lambda t: (own.encode(t or "").astype("<u4").tobytes(),)

    return _mapped(docs, text, make, (out,))


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with `out`: the bytes of its ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = codec(sent.value, pattern)
        return lambda b: (own.decode(np.frombuffer(b or b"", "<u4")),)

    return _mapped(encoded, ids, make, (out,))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass, so that a task needs one Python worker and not two: `docs` with its ids and their bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = codec(sent.value, pattern)

        def both(t: str | None) -> tuple[bytes, bytes]:
            made = own.encode(t or "").astype("<u4").tobytes()
            return made, own.decode(np.frombuffer(made, "<u4"))

        return both

    return _mapped(docs, text, make, (ids, decoded))
