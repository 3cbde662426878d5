"""Token ids in a word-aligned binary format (Simple-8b), and word-wise tokenization.

The format. A file set is a Parquet folder; each row is one shard: `part` and `before` (the ids of the part
before the shard; their order is the order of the documents), n_docs, n_ids, `keys` (the documents' ids,
packed int64) and two binary streams in one code, `lengths` (ids per document) and `body` (all ids).

A stream is: magic, number of values, number of blocks; then for each block of 1024 values the offset
of its first word and whether it has escapes; then 64-bit words. A word's upper 4 bits select how many
values of how many bits fill its lower 60. Selector 0 is the escape: the next word is one raw value.
Blocks begin with a word of their own, so that all blocks of a stream are coded and decoded in step by
array operations; only a block with escapes is decoded word by word.

Null and empty texts have no ids but the end id. Repeated rows are documents of their own, in an order that doesn't matter as they
are equal; documents with one id go by a hash of their text, those without id last. Very long texts are encoded whole, and columns but
doc_id and text left out. An empty table gives an empty set.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, written

MAGIC = b"S8B1"
BLOCK = 1024
#: Values per word, by selector; the bits of each value are 60 // count. Selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
ESCAPE, LAST = 0, 14


def pack(values: np.ndarray) -> bytes:
    """A stream of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    width = np.zeros(n + 60, np.uint8)
    width[:n] = np.frexp(values.astype(np.float64))[1]  # bit lengths; rounding up to a power of two only widens
    width[:n][values >> np.uint64(60) > 0] = 64
    place = np.arange(n, dtype=np.int32)
    rest = BLOCK - place % BLOCK  # values up to the end of the block
    rest[n - n % BLOCK :] -= BLOCK - n % BLOCK if n % BLOCK else 0
    # The widest of the next c values for each count c; the last selector under which they fit is the best.
    widest, span, best = width[: n + 59].copy(), 1, np.full(n, ESCAPE, np.uint8)
    for s in range(LAST, 0, -1):
        while span < COUNTS[s]:
            grow = min(span, int(COUNTS[s]) - span)
            widest = np.maximum(widest[: len(widest) - grow], widest[grow:])
            span += grow
        np.copyto(best, np.uint8(s), where=(widest[:n] <= BITS[s]) & (rest >= COUNTS[s]))
    # Follow the chain of words through all blocks in step.
    at, ends = np.arange(blocks) * BLOCK, np.minimum(n, (np.arange(blocks) + 1) * BLOCK)
    block, starts, owners = np.arange(blocks), [], []
    while len(at):
        starts.append(at)
        owners.append(block)
        at = at + COUNTS[best[at]]
        go = at < ends[block]
        at, block = at[go], block[go]
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    start.sort()
    owner = start // BLOCK
    chosen = best[start].astype(np.int64)
    size = np.where(chosen == ESCAPE, 2, 1)
    word_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[word_at] = chosen.astype(np.uint64) << np.uint64(60)
    words[word_at[chosen == ESCAPE] + 1] = values[start[chosen == ESCAPE]]
    for s in range(1, LAST + 1):
        own = np.flatnonzero(chosen == s)
        if len(own):
            shifts = np.arange(COUNTS[s]).astype(np.uint64) * np.uint64(BITS[s])
            taken = values[start[own][:, None] + np.arange(COUNTS[s])[None, :]] << shifts
            words[word_at[own]] |= np.bitwise_or.reduce(taken, axis=1)
    first = np.searchsorted(owner, np.arange(blocks))
    escapes = np.zeros(blocks, np.uint64)
    escapes[owner[chosen == ESCAPE]] = 1
    index = (word_at[first].astype(np.uint64) << np.uint64(1)) | escapes if blocks else np.empty(0, np.uint64)
    return MAGIC + struct.pack("<IQ", blocks, n) + index.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The values of a stream."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b stream")
    blocks, n = struct.unpack_from("<IQ", data, 4)
    index = np.frombuffer(data, "<u8", blocks, 16)
    words = np.frombuffer(data, "<u8", -1, 16 + 8 * blocks)
    first, escaped = (index >> np.uint64(1)).astype(np.int64), (index & np.uint64(1)).astype(bool)
    ends = np.r_[first[1:], len(words)]
    out = np.zeros(n, np.uint64)
    plain = np.ones(len(words), bool)
    for k in np.flatnonzero(escaped):
        plain[first[k] : ends[k]] = False
        at, w = k * BLOCK, first[k]
        while w < ends[k]:
            s = int(words[w] >> np.uint64(60))
            if s == ESCAPE:
                out[at] = words[w + 1]
                at, w = at + 1, w + 2
                continue
            c, b = int(COUNTS[s]), int(BITS[s])
            out[at : at + c] = (words[w] >> (np.arange(c).astype(np.uint64) * np.uint64(b))) & np.uint64((1 << b) - 1)
            at, w = at + c, w + 1
    where = np.flatnonzero(plain)
    selector = (words[where] >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    owner = np.searchsorted(first, where, side="right") - 1
    before = np.cumsum(counts) - counts
    heads = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
    base = np.repeat(before[heads], np.diff(np.r_[np.flatnonzero(heads), len(owner)])) if len(owner) else before
    at = owner * BLOCK + before - base
    for s in range(1, LAST + 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            shifts = np.arange(COUNTS[s]).astype(np.uint64) * np.uint64(BITS[s])
            out[at[own][:, None] + np.arange(COUNTS[s])[None, :]] = (words[where[own]][:, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
    return out


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose tokens never cross white space, word by word.

    Words seen before come from a bounded cache, new ones from the library. Latin-1 texts are handled as
    bytes: if the tokenizer ignores case and cuts between a letter and a closing mark (both are tried
    out first), they are lower-cased and cut there, so that fewer words differ. Words of Latin-1 letters
    then go to the library's model as they are, byte by byte, if that is found to give what the whole
    library gives. All other words go to the whole library, in one batch.
    """

    CACHED = 500_000
    CLOSERS = ".,"
    #: Characters that str.split takes for blanks and the tokenizer may not.
    ODD = "\x1c\x1d\x1e\x1f"
    LETTERS = [chr(c) for c in range(0x100) if chr(c).isalpha()]

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.model = self.library.model
        self.known: dict[str | bytes, bytes] = {}
        plain = lambda t: self.library.encode(t, add_special_tokens=False).ids
        letters = self.LETTERS
        samples = [*letters, "".join(letters), *("".join(letters[k::7]) for k in range(7)), *("".join(letters[k : k + 6]) for k in range(0, len(letters), 3))]
        # Byte-level models write a byte as a character: printable Latin-1 as itself, others from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(0x100) if b not in printable]
        self.byte_char = {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
        self.lower = bytes(ord(chr(b).lower()) for b in range(0x100))
        caseless = all(plain(w.lower()) == plain(w) for w in samples)
        closing = all(plain(w + c + x) == plain(w) + plain(c + x) for w in ("a", "word", "élan", "ß", "7", "x1") for c in self.CLOSERS for x in ("", "b", "!!", "..", "5"))
        self.fast = caseless and closing and "." in self.CLOSERS
        self.direct = self.fast and all(self.by_model(w.lower()) == plain(w) for w in samples)
        # Where a mark follows another mark, a cut would change tokens.
        self.kinds = bytes(ord("d") if chr(b) in self.CLOSERS else ord("w") if chr(b).isalpha() or chr(b) in "0123456789 \n\t\r" else ord("p") for b in range(0x100))

    def split(self, text: str) -> list:
        if self.fast and "<" not in text:
            try:
                data = text.encode("latin-1")
            except UnicodeEncodeError:
                data = None
            if data is not None:
                kinds = data.translate(self.kinds)
                data = data.translate(self.lower)
                if b"pd" not in kinds and b"dd" not in kinds:
                    for c in self.CLOSERS.encode():
                        data = data.replace(bytes([c]), bytes([32, c]))
                return data.split()
        if any(c in text for c in self.ODD):
            return [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
        return text.split()

    def by_model(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.byte_char)
        return [t.id for t in self.model.tokenize(word)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        words = set().union(*split) if split else set()
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.CACHED:
            # What this batch needs is likelier to come again than the rest.
            self.known = {w: self.known[w] for w in words.intersection(self.known)}
        whole, known = [], self.known
        for w in new:
            if self.direct and isinstance(w, bytes) and (s := w.decode("latin-1")).isalpha():
                known[w] = array("I", self.by_model(s)).tobytes()
            else:
                whole.append(w)
        made = self.library.encode_batch_fast([w.decode("latin-1") if isinstance(w, bytes) else w for w in whole], add_special_tokens=False)
        known.update((w, array("I", e.ids).tobytes()) for w, e in zip(whole, made, strict=True))
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), np.uint32) for own in split]


_tokenizers: dict[int, WordTokenizer] = {}


def tokenizer(definition: str) -> WordTokenizer:
    """One tokenizer in each Python worker."""
    key = hash(definition)
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(definition)
    return _tokenizers[key]


#: Characters that are tokenized at once, and ids of a shard.
CHARS, SHARD_IDS = 4_000_000, 1_000_000
SHARD_SCHEMA = "before long, doc_null boolean, n_docs long, n_ids long, keys binary, lengths binary, body binary"


def write_ids(docs: DataFrame, definition: str, end_id: int | None = 1, rows_per_part: int = 20_000) -> DataFrame:
    """Tokenize (doc_id, text) of `docs`, write the shards in ascending doc_id order, and return the written table.

    Null texts count as empty. Null doc_ids come first; rows with one doc_id are ordered by their text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(definition)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(sent.value)
        before, keys, ids, size = 0, [], [], 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal before, keys, ids, size
            missing = [k is None for k in keys]
            row = [before, missing[0], len(keys), size, np.array([k or 0 for k in keys], "<i8").tobytes(), pack(np.array([len(x) for x in ids])), pack(np.concatenate(ids))]
            before, keys, ids, size = before + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[f.split()[0] for f in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            for part in _parts(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                for (key, _), made in zip(part, own.encode([t for _, t in part]), strict=True):
                    if keys and (key is None) != (keys[0] is None):
                        yield close()
                    keys.append(key)
                    ids.append(np.concatenate([made, tail]))
                    size += len(ids[-1])
                    if size >= SHARD_IDS:
                        yield close()
        if keys:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = partitions(spark, rows.count(), rows_per_part)
    # Rows that share an id, or have none, are spread by a hash of their texts.
    order = (F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    return written(ordered.mapInArrow(shards, SHARD_SCHEMA).select(F.spark_partition_id().alias("part"), "*"), "token-ids")


def _parts(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows (key, text scalar) in lists of bounded text."""
    part, size = [], 0
    for key, text in rows:
        part.append((key, text.as_py() or ""))
        size += len(part[-1][1])
        if size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    # One number per written part reaches the driver, as Spark itself keeps some per task.
    totals = {r.part: r.total for r in shards.groupBy("part").agg(F.sum("n_ids").alias("total")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    sent = shards.sparkSession.sparkContext.broadcast(base)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, missing, keys, lengths, body = (batch.column(k)[row].as_py() for k in range(6))
                start = sent.value[part] + before
                sizes = unpack(lengths).astype(np.int64)
                ids = unpack(body).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                doc_ids = np.frombuffer(keys, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, mask=np.full(len(doc_ids), missing)),
                        pa.array(begins + start),
                        pa.array(sizes),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return shards.select("part", "before", "doc_null", "keys", "lengths", "body").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
