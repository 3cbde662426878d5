"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits, letters and all characters beyond ASCII; A-Z is lower-cased. A window is
`words` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

Of the `words - gram + 1` grams of a window the one with the smallest hash is its fingerprint, so
equal windows have the same one: every shared span of `words` words or more shares a fingerprint, and a run
of words has few of them. A filter of the benchmark's fingerprints, whose size is fixed by FILTER_BITS and not by
the data, spares those of a document that no item has. The others are joined with the benchmark's, and
the hit is extended to the window around it, by a 128-bit digest of the window's words. Windows of shorter items are
grams of their own length.

Copies are looked up once: results belong to distinct texts (by 128-bit digest) and are joined to their rows at the end.
Windows that the same items have are one class, and texts with the same classes one set, so that items are listed once for
each set and not for each document.

Null texts have no words; neither have empty ones. Repeated rows and ids have results of their own.
Items with the same id are one item; those without id hit words but are neither counted nor listed.
Very long texts are read whole, at some ten times their size in a task. An empty table on either side
gives no hits. Columns other than the named ones are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, released, small_batches, written

#: Bits of the filter that is sent to all tasks: 4 MB, whatever the benchmark.
FILTER_BITS = 1 << 25
#: Bits in a row of Spark's bitmap functions.
BITMAP = 32768
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The folded words of a UTF-8 text."""
    return text.translate(_FOLD).split()


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A hash of each `gram` consecutive words."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - gram + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(gram):
            out = (out ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def leading(words: list[bytes], size: int, gram: int) -> np.ndarray:
    """The fingerprint of each window of `size` words: the smallest hash of its grams, or of the window if it is shorter than a gram."""
    grams = gram_hashes(words, min(size, gram))
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = grams[:n].copy()
    for k in range(1, size - min(size, gram) + 1):
        np.minimum(out, grams[k : k + n], out=out)
    return out


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def benchmark_windows(items: DataFrame, words: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """size, fp, digest and item (as a string) of each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                own = words_of(text.as_py() or b"")
                if not own:
                    continue
                size = min(len(own), words)
                found = {_digest(own[k : k + size]): fp for k, fp in enumerate(leading(own, size, gram).view(np.int64).tolist())}
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64()), pa.array(list(found), pa.binary()), pa.array([item.as_py()] * len(found), pa.string())], names=["size", "fp", "digest", "item"])

    made = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(released(run), "size int, fp long, digest binary, item string")
    return made.distinct()


def _bit(fp: Column) -> Column:
    return F.pmod(fp, F.lit(FILTER_BITS)) + 1


def fingerprint_filter(windows: DataFrame) -> np.ndarray:
    """A bit for each fingerprint modulo FILTER_BITS, packed from the lowest bit."""
    bit = _bit(F.col("fp"))
    rows = windows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows.collect():  # FILTER_BITS / BITMAP rows of 4 KB at most
        at = (row.bucket - 1) * (BITMAP // 8)
        out[at : at + BITMAP // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def candidates(docs: DataFrame, sizes: list[int], bits: np.ndarray, gram: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (digest of the text), n_words and hits: the windows whose fingerprint is in the filter, with the words they begin at."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    hit = pa.struct([("size", pa.int32()), ("fp", pa.int64()), ("digest", pa.binary()), ("at", pa.list_(pa.int32()))])

    def found(own: list[bytes]) -> list[dict]:
        out: dict[bytes, dict] = {}
        for size in sizes:
            fps = leading(own, size, gram)
            place = fps.view(np.int64) % FILTER_BITS
            for k in np.flatnonzero((sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1).tolist():
                digest = _digest(own[k : k + size])
                if digest in out:
                    out[digest]["at"].append(k)
                else:
                    out[digest] = {"size": size, "fp": int(fps[k].view(np.int64)), "digest": digest, "at": [k]}
        return list(out.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, hits = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                whole = text.as_py() or b""
                own = words_of(whole)
                keys.append(xxhash.xxh3_128_digest(whole))
                counts.append(len(own))
                hits.append(found(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(hit))], names=["doc_id", "key", "n_words", "hits"])

    schema = "doc_id long, key binary, n_words long, hits array<struct<size:int,fp:bigint,digest:binary,at:array<int>>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def _set_of(*cols: str) -> list[Column]:
    """Count and two hash sums that name a set of distinct rows."""
    return [F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(*cols, F.lit(k))).alias(f"h{k}") for k in (1, 2))]


def _named(n: str = "n") -> Column:
    return F.concat_ws(":", n, "h1", "h2")


def matches(docs: DataFrame, items: DataFrame, words: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every row's doc_id, key and n_words; key, class, size and at of each text's hit windows; class and item), all written."""
    windows = written(benchmark_windows(items, words, gram, item_col, item_text), "benchmark-windows")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())
    every = written(candidates(docs, sizes, fingerprint_filter(windows), gram, id_col, text_col), "fingerprints")
    classes = windows.groupBy("size", "fp", "digest").agg(*_set_of("item")).select(F.col("size").alias("s"), F.col("fp").alias("f"), F.col("digest").alias("d"), _named().alias("class"))
    classes = written(classes, "classes")
    one = F.min(F.struct("s", "f", "d")).alias("one")
    first = classes.groupBy("class").agg(one).select("class", "one.*")
    class_items = first.join(windows, (F.col("s") == F.col("size")) & (F.col("f") == F.col("fp")) & (F.col("d") == F.col("digest"))).select("class", "item").where("item IS NOT NULL").distinct()
    class_items = written(class_items, "class-items")
    own = every.where(F.size("hits") > 0).select("key", "hits").dropDuplicates(["key"]).select("key", F.explode("hits").alias("hit")).select("key", "hit.*")
    met = own.join(classes, (F.col("fp") == F.col("f")) & (F.col("size") == F.col("s")) & (F.col("digest") == F.col("d"))).select("key", "class", "size", "at")
    met = written(met, "matches")
    discard(classes)
    discard(windows)
    return every.select("doc_id", "key", "n_words"), met, class_items


def spans(met: DataFrame) -> DataFrame:
    """key, start and stop (word numbers, stop excluded) of the merged hit spans of each text; its words bound a text's group."""
    each = met.select("key", "size", F.explode("at").alias("at"))
    before = Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("new", (F.col("at") > F.coalesce(F.max(F.col("at") + F.col("size")).over(before), F.lit(-1))).cast("int"))
    each = each.withColumn("span", F.sum("new").over(upto))
    return each.groupBy("key", "span").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("stop")).drop("span")


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 10, gram: int = 5, **columns: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (start, stop) of every row of `docs`."""
    every, met, class_items = matches(docs, items, words, gram, **columns)
    hit = spans(met).groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    sets = met.select("key", "class").distinct()
    named = written(sets.groupBy("key").agg(*_set_of("class")).select(F.col("key").alias("k"), _named().alias("set")), "sets")
    first = named.groupBy("set").agg(F.min("k").alias("one"))
    listed = first.join(sets, F.col("one") == F.col("key")).select("set", F.col("class").alias("c")).join(class_items, F.col("c") == F.col("class")).select("set", "item").distinct()
    listed = listed.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    by_text = hit.join(named, F.col("key") == F.col("k")).join(listed.withColumnRenamed("set", "l"), F.col("set") == F.col("l"), "left").select("k", "n_hit", "spans", "n_items", "items_sha256")
    out = every.join(written(by_text, "hits"), F.col("key") == F.col("k"), "left")
    for table in (met, class_items, named):
        discard(table)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"))
