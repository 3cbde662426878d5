"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, by count joins.

The model is over characters, where all capitals count as one and all digits as another; there is no limit to the
alphabet. What is before a text is one more symbol. An n-gram is known by a 64-bit hash. N-grams of the highest order are counted in all
trusted text: tasks add up their own parts, and the parts meet by n-gram. Lower orders count in how many
different contexts an n-gram goes on. Discounts come from the counts of counts; joins by context and by
suffix give the probabilities. All tables grow with the trusted text, and none of them leaves the executors.

A text's score is a sum over its n-grams: log p of a place is the log of the share that its context leaves to lower orders, plus log p of the lower order, plus,
if the n-gram was seen, the gain of that. So the count of an n-gram in a text, of whatever order, times its gain and
its share as a context is all that it adds. Documents are turned into blocks of (n-gram, document, count), cut into shards by the n-gram's
hash; a shard meets its part of the model, and sends each block the sums of its documents. Texts are read once for that and not shuffled.
Trusted texts meet their labels by id; a filter of fixed size holds back most others before the shuffle.

A document is kept if its perplexity is at most `slack` times the `quantile` of that of the trusted documents in its
language (of all trusted documents if its language has fewer than `least` of them, or is null). Short
texts are judged with `prior` symbols at the trusted mean added, as their own mean varies. With `folds`, the model
learns from all trusted documents but those whose hashed id falls in the first of so many parts, and mean and quantiles are
of that part alone: texts the model has seen would set thresholds too low for unseen ones. If no text of that part
can be scored, all trusted ones set the thresholds.

Null and empty texts have a null perplexity and are not kept. Without any trusted text all
perplexities are null and nothing is kept. Very long texts are scored whole. Repeated rows are scored alike; labels may repeat (a document is
trusted if one label says so). Other columns are left out, so none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, released, small_batches, small_table, written

ORDER = 3
#: Code points are numbered from 1; 0 is what is before a text.
POINTS = 0x110000
#: Documents and characters of a block at most, but for a longer text; characters counted at once in training; bytes of n-grams in a shard.
BLOCK_ROWS, CHUNK, SHARD_BYTES = 4096, 4_000_000, 32 << 20
#: Bits of the filter of trusted ids: 4 MB, whatever their number.
FILTER_BITS = 1 << 25


def fold(text: str) -> np.ndarray:
    """Code points with all capitals as A and all digits as 0."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _classes()[cps]


_class_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _class_table:
        made = np.arange(POINTS, dtype=np.uint32)
        for cp in range(POINTS):
            c = chr(cp)
            made[cp] = ord("A") if c.isupper() else ord("0") if c.isdigit() else cp
        _class_table.append(made)
    return _class_table[0]


def symbols(text: str, order: int) -> np.ndarray:
    """The folded text as numbers, with order - 1 zeros before it."""
    return np.r_[np.zeros(order - 1, np.uint64), fold(text).astype(np.uint64) + np.uint64(1)]


def hashes(seq: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive symbols; the hash of none is a constant."""
    out = np.full(len(seq) - k + 1, 0x5851F42D4C957F2D + k, np.uint64)
    for j in range(k):
        out = (out ^ seq[j : len(seq) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def ngram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """g1 ... gN, x1 ... xN, c: how often each n-gram of the highest order occurs in column text; its ends of all orders, and their contexts."""
    names = [f"g{k}" for k in range(1, order + 1)] + [f"x{k}" for k in range(1, order + 1)]

    def ends(text: str) -> np.ndarray:
        seq = symbols(text, order)
        n = len(seq) - order + 1
        every = {k: hashes(seq, k) for k in range(order + 1)}
        # The window of k symbols that ends at a text's place i begins at i + order - k in the padded sequence.
        grams = [every[k][order - k : order - k + n] for k in range(1, order + 1)]
        return np.stack(grams + [every[k - 1][order - k : order - k + n] for k in range(1, order + 1)], axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, totals = np.empty((0, 2 * order), np.uint64), np.empty(0, np.int64)
        held, size = [], 0

        def merge() -> None:
            nonlocal rows, totals, held, size
            every = np.concatenate([rows, *held])
            _, first, at = np.unique(every[:, order - 1], return_index=True, return_inverse=True)
            totals = np.bincount(at, np.concatenate([totals, np.ones(len(every) - len(rows), np.int64)]), len(first)).astype(np.int64)
            rows, held, size = every[first], [], 0

        for batch in batches:
            for text in batch.column(0):
                own = text.as_py()
                if own:
                    held.append(ends(own))
                    size += len(own)
                    if size >= CHUNK // 4:
                        merge()
        if held:
            merge()
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, j]).view(np.int64)) for j in range(2 * order)), pa.array(totals)], names=[*names, "c"])

    made = texts.select("text").mapInArrow(released(count), ", ".join(f"{c} long" for c in names) + ", c long")
    top = f"g{order}"
    return made.groupBy(top).agg(*[F.first(c).alias(c) for c in names if c != top], F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and from 3 on."""
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (float(n.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    ratio = lambda a, b: a / b if b else 0.0
    return [min(max(k - (k + 1) * y * ratio(b, a), 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


class Model(NamedTuple):
    """`values` (h, gain, share): what a hashed n-gram adds, in bits, where it ends and where it is a context; `place`: what every place adds; `start`: what the begin of a text adds."""

    values: DataFrame
    place: float
    start: float


def kneser_ney(counts: DataFrame, order: int = ORDER) -> Model | None:
    """The model of ngram_counts(); None of nothing."""
    by_order = {order: counts.select(F.col(f"g{order}").alias("gram"), F.col(f"x{order}").alias("context"), (F.col(f"g{order - 1}") if order > 1 else F.lit(0).cast("long")).alias("suffix"), "c")}
    rows = counts
    for k in range(order - 1, 0, -1):
        lower = [F.first(c).alias(c) for j in range(1, k + 1) for c in (f"g{j}", f"x{j}") if c != f"g{k}"]
        rows = written(rows.groupBy(f"g{k}").agg(*lower, F.count("*").alias("c")), f"order-{k}")
        by_order[k] = rows.select(F.col(f"g{k}").alias("gram"), F.col(f"x{k}").alias("context"), (F.col(f"g{k - 1}") if k > 1 else F.lit(0).cast("long")).alias("suffix"), "c")
    letters = by_order[1].count()
    if not letters:
        return None
    lower, gains, shares, place = None, [], [], 0.0
    for k in range(1, order + 1):
        d = discounts(by_order[k])
        grams = by_order[k].withColumn("d", F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]))
        contexts = grams.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("freed")).select(F.col("context").alias("x"), "total", F.greatest(F.col("freed") / F.col("total"), F.lit(LEAST_SHARE)).alias("back"))
        met = grams.join(contexts, F.col("context") == F.col("x"))
        below = F.lit(1.0 / (letters + 1))  # one for all symbols that were never seen
        if lower is not None:
            met = met.join(lower, F.col("suffix") == F.col("s"))
            below = F.col("below")
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("back") * below
        made = written(met.select("gram", p.alias("p"), F.log2(p / (F.col("back") * below)).alias("gain")), f"gains-{k}")
        lower = made.select(F.col("gram").alias("s"), F.col("p").alias("below"))
        gains.append(made.select(F.col("gram").alias("h"), "gain", F.lit(0.0).alias("share")))
        if k == 1:
            place = math.log2(contexts.first().back / (letters + 1))
        else:
            shares.append(contexts.select(F.col("x").alias("h"), F.lit(0.0).alias("gain"), F.log2("back").alias("share")))
    values = functools.reduce(DataFrame.unionByName, gains + shares).groupBy("h").agg(F.sum("gain").alias("gain"), F.sum("share").alias("share"))
    values = written(values, "values")
    begins = [int(hashes(np.zeros(k, np.uint64), k)[0].view(np.int64)) for k in range(1, order)]
    start = values.where(F.col("h").isin(begins)).agg(F.sum("share").alias("s")).first().s
    return Model(values, place, start or 0.0)


#: A context whose n-grams were all seen three times and more leaves nothing to lower orders by its counts; it leaves this.
LEAST_SHARE = 1e-9


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first, compressed: most have nothing in the others."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unplaned(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view("<u4").ravel().astype(np.int64)


def packed_shards(texts: list[str], order: int, shards: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """(shard, n-grams, how many documents each is in, steps from document to document, counts) of a block.

    A count is doubled, plus one for the n-gram at a text's end, which is no context.
    """
    parts = []
    for d, text in enumerate(texts):
        if text:
            seq = symbols(text, order)
            for k in range(1, order + 1):
                own = hashes(seq[order - k :], k)
                found, n = np.unique(own, return_counts=True)
                n = 2 * n
                n[np.searchsorted(found, own[-1])] += 1
                parts.append((found, np.full(len(found), d), n))
    if not parts:
        return
    grams, doc, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order_ = np.lexsort((doc, grams))
    grams, doc, n = grams[order_], doc[order_], n[order_]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    step = np.diff(doc, prepend=0)
    step[first] = doc[first]
    many, distinct = np.diff(np.r_[first, len(grams)]), grams[first]
    shard = ((distinct >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    edges = np.r_[first, len(grams)]
    for j in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[j], cuts[j + 1]
        lo, hi = edges[a], edges[b]
        yield j, distinct[a:b].tobytes(), _planes(many[a:b]), _planes(step[lo:hi]), _planes(n[lo:hi])


def block_sums(keys: np.ndarray, gain: np.ndarray, share: np.ndarray, grams: bytes, many: bytes, steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents, what a shard's n-grams add to each) by its part of the model, sorted by key."""
    own, many, step, n = np.frombuffer(grams, np.uint64), _unplaned(many), _unplaned(steps), _unplaned(counts)
    total = np.cumsum(step)
    first = np.cumsum(many) - many
    doc = total - np.repeat(total[first] - step[first], many)
    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
    known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
    g, s = (np.repeat(np.where(known, v[at] if len(keys) else 0.0, 0.0), many) for v in (gain, share))
    docs, at = np.unique(doc, return_inverse=True)
    return docs, np.bincount(at, (n >> 1) * g + ((n >> 1) - (n & 1)) * s, len(docs))


WORK = "shard int, kind int, block long, h long, gain double, share double, ids binary, grams binary, many binary, steps binary, counts binary"
_FIELDS = [c.split()[0] for c in WORK.split(", ")]
META, MODEL, PAIRS = 0, 1, 2


def _blocks(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """Rows of WORK: of each block its documents (ids: rows of Arrow), and its n-grams for each shard."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            lengths = pa.array([len(t) for t in texts], pa.int64())
            table = pa.Table.from_batches(held).combine_chunks().append_column("symbols", lengths)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            made = [(base % shards, META, base, None, None, None, sink.getvalue().to_pybytes(), None, None, None, None)]
            made += [(j, PAIRS, base, None, None, None, None, *data) for j, *data in packed_shards(texts, order, shards)]
            for r in made:  # one at a time, so that no batch gets large
                yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r, strict=True))], schema=_SCHEMA)

        for batch in batches:
            for k, text in enumerate(batch.column(len(names) - 1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                held.append(batch.slice(k, 1).select(names[:-1]))
                if size >= CHUNK or len(texts) >= BLOCK_ROWS:
                    yield from rows()
                    base, held, texts, size = base + 1, [], [], 0
        if texts:
            yield from rows()

    return docs.mapInArrow(released(run), WORK)


_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("h", pa.int64()), ("gain", pa.float64()), ("share", pa.float64()), *((c, pa.binary()) for c in ("ids", "grams", "many", "steps", "counts"))])


def score(docs: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """doc_id, lang, symbols long and bits double (the sum of -log2 p) of every row of `docs` (doc_id, lang, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    size = docs.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    shards = partitions(spark, size, SHARD_BYTES * 2)  # about half a byte for each character
    work = _blocks(docs, order, shards)
    of = F.shiftright(F.shiftrightunsigned("h", 32) * shards, 32).cast("int")
    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in WORK.split(", ")) if c not in ("shard", "kind", "h", "gain", "share")]
    known = model.values.select(of.alias("shard"), F.lit(MODEL).alias("kind"), "h", "gain", "share", *none).select(*_FIELDS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys = [], None
        for batch in batches:
            kind = batch.column(1).to_numpy()
            held.append(batch.select([3, 4, 5]).filter(pa.array(kind == MODEL)))
            for row in batch.filter(pa.array(kind != MODEL)).to_pylist():
                if row["kind"] == META:
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["ids"]], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=["block", "ids", "docs", "sums"])
                    continue
                if keys is None:
                    h, gain, share = (np.concatenate([b.column(j).to_numpy(zero_copy_only=False) for b in held]) for j in range(3))
                    at = np.argsort(h.view(np.uint64))
                    keys, gain, share = h.view(np.uint64)[at], gain[at], share[at]
                found, sums = block_sums(keys, gain, share, row["grams"], row["many"], row["steps"], row["counts"])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.nulls(1, pa.binary()), pa.array([found.astype("<i4").tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["block", "ids", "docs", "sums"])

    # Documents first, then the model, then n-grams: a task holds its part of the model and one block at a time.
    parts = work.unionByName(known).repartition(shards, "shard").sortWithinPartitions("kind").mapInArrow(released(meet), "block long, ids binary, docs binary, sums binary")

    def close(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = pa.ipc.open_stream(next(r["ids"] for r in rows if r["ids"])).read_all()
        sums = np.zeros(own.num_rows)
        for r in rows:
            if r["docs"]:
                sums[np.frombuffer(r["docs"], "<i4")] += np.frombuffer(r["sums"])
        n = own.column("symbols").to_numpy()
        bits = np.where(n > 0, -(sums + n * model.place + model.start), 0.0)
        return pa.Table.from_arrays([own.column("doc_id").cast(pa.int64()), own.column("lang").cast(pa.string()), pa.array(n), pa.array(bits)], names=["doc_id", "lang", "symbols", "bits"])

    model = model._replace(values=None)
    return parts.groupBy("block").applyInArrow(close, "doc_id long, lang string, symbols long, bits double")


def _perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of all documents whose id is in `ids` (column t), and of few others: by a filter of fixed size."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in ids.groupBy(F.bitmap_bucket_number(bit("t")).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit("t"))).alias("bits")).collect():
        bits[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy() - 1
            yield batch.filter(pa.array(((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))).select([0, 1])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return own.select("doc_id", "text", bit("doc_id").alias("bit")).mapInArrow(run, "doc_id long, text string")


def classify(docs: DataFrame, labels: DataFrame, trusted: Column | None = None, quantile: float = 0.99, slack: float = 1.1, least: int = 50, prior: float = 32.0, folds: int | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every row; `trusted` is a condition on `labels`."""
    small_batches(docs.sparkSession)
    good = labels.where(F.expr("quality = 1 AND toxic = 0") if trusted is None else trusted).select(F.col("doc_id").alias("t")).where("t IS NOT NULL").distinct()
    held = F.pmod(F.xxhash64("t"), F.lit(folds)) == 0 if folds else F.lit(False)
    learn = good.where(~held)
    texts = _perhaps(docs, learn).join(learn.hint("shuffle_hash"), F.col("doc_id") == F.col("t"), "left_semi").select("text")
    counts = written(ngram_counts(texts, order), "counts")
    model = kneser_ney(counts, order)
    if model is None:
        scored = docs.select("doc_id", "lang", F.lit(0).cast("long").alias("symbols"), F.lit(0.0).alias("bits"))
    else:
        scored = score(docs.select("doc_id", "lang", "text"), model, order)
    scored = written(scored, "scored")
    scored = scored.join(good, F.col("doc_id") == F.col("t"), "left").withColumn("held", F.coalesce(held & F.col("t").isNotNull(), F.lit(False)))
    means = {r.held: r.m for r in scored.where("t IS NOT NULL").groupBy("held").agg(F.try_divide(F.sum("bits"), F.sum("symbols")).alias("m")).collect()}
    apart = means.get(True) is not None and means.get(False) is not None
    mean = means.get(apart)
    rate = F.when((F.col("symbols") > 0) & F.lit(mean is not None), (F.col("bits") + prior * (mean or 0.0)) / (F.col("symbols") + prior))
    scored = written(scored.select("doc_id", "lang", F.when(F.lit(mean is not None) & (F.col("symbols") > 0), F.pow(F.lit(2.0), F.col("bits") / F.col("symbols"))).alias("perplexity"), rate.alias("rate"), (F.col("held") if apart else F.col("t").isNotNull()).alias("judge")), "rated")
    own = scored.where("judge AND rate IS NOT NULL")
    cut = F.percentile_approx("rate", F.lit(quantile), F.lit(100_000))
    every = own.agg(cut.alias("q")).first().q
    by_lang = own.groupBy("lang").agg(cut.alias("q"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("lang").isNotNull()).select("lang", "q").collect()
    by_lang = small_table(docs.sparkSession, [{"l": r.lang, "q": r.q} for r in by_lang], "l string, q double")
    out = scored.join(by_lang, F.col("lang") == F.col("l"), "left").withColumn("q", F.coalesce("q", F.lit(every).cast("double")))
    return out.select("doc_id", "lang", "perplexity", (slack * F.pow(F.lit(2.0), "q")).alias("threshold"), F.coalesce(F.col("rate") <= F.col("q") + math.log2(slack), F.lit(False)).alias("kept"))
