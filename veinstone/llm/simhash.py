"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half of the XXH64 values (seed 42) of its word
shingles have it. Two fingerprints link if they differ in `radius` bits or fewer.

Every distinct fingerprint emits all its variants within half the radius, and equal variants meet: for
an even radius r two fingerprints within r bits share a variant at r/2 from both. An odd radius leaves
one bit over. That bit is absorbed by blocks: the highest differing bit lies in some block of the 64
bits, so for each block a variant hides that block and flips at most (radius - 1)/2 bits below it.
For radius 3 and four blocks these are 1 + 17 + 33 + 49 = 100 variants. Colliding pairs are verified.

A variant's group can hold 49 * 2**16 distinct fingerprints at most, 26 MB, however many documents
there are: copies are one fingerprint. A group emits no pairs but the links of a spanning forest.

Null and empty texts, and texts without words, have fingerprint 0 and link like any other. Texts with
fewer words than a shingle has are one shingle. Repeated rows and ties get the same component; its id
is its smallest doc_id, nulls apart (null if all are). An empty table gives an empty result. Columns
other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, packed, partitions, released, small_batches, written
from .components import Forest, connected_components

SEED = 42
#: Variants that one task sorts and verifies, 16 bytes each.
TASK_VARIANTS = 500_000
#: A run of equal variants up to this length is compared pair by pair; a longer one by enumerating balls.
PAIR_RUN = 1024


def shingles(text: bytes, n: int) -> list[bytes]:
    """The n-word shingles of a UTF-8 text, A-Z lower-cased, words between ASCII blanks."""
    words = text.lower().split()
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))


def hashes_of(text: bytes, n: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    parts = shingles(text, n)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, n: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    return majority(hashes_of(text, n))


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, hash (xxhash64 of the text) and fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            made = np.fromiter((fingerprint(t.as_py() or b"", n) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made.view(np.int64))], names=["doc_id", "hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash")).mapInArrow(released(run), "doc_id long, hash long, fp long")


def masks(radius: int = 3, blocks: int = 4) -> list[tuple[int, int]]:
    """(bits that stay visible, bits to flip) of each variant."""
    flips, out = radius // 2, []
    if radius % 2 == 0:
        return [((1 << 64) - 1, _bits(c)) for f in range(flips + 1) for c in combinations(range(64), f)]
    size = 64 // blocks
    for block in range(blocks):
        visible = ((1 << 64) - 1) ^ (((1 << size) - 1) << (block * size))
        below = range(block * size)
        out += [(visible, _bits(c)) for f in range(flips + 1) for c in combinations(below, f)]
    return out


def _bits(places: tuple[int, ...]) -> int:
    return sum(1 << p for p in places)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of unsigned 64-bit numbers, to deal keys out evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def linked(keys: np.ndarray, fps: np.ndarray, radius: int, edges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs that share a key and differ in `radius` bits or fewer.

    The links lead to the roots of the forest; with `edges` they are such pairs themselves, hardly more of them.
    """
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    values, node = np.unique(fps, return_inverse=True)
    forest = Forest(len(values))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        if edges:
            new = forest.roots(a) != forest.roots(b)
            pairs.append((values[a[new]], values[b[new]]))
        forest.link(a, b)

    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    lengths = np.diff(np.r_[starts, len(keys)])
    # Short runs: compare each member with the one `step` places on, all runs at once.
    short = (lengths > 1) & (lengths <= PAIR_RUN)
    at = np.repeat(starts[short], lengths[short]) + _within(lengths[short])
    left = np.repeat(lengths[short], lengths[short]) - _within(lengths[short])
    step = 1
    while len(at):
        keep = left > step
        at, left = at[keep], left[keep]
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= radius
        link(node[at[near]], node[at[near] + step])
        step += 1
    # Long runs: look each member's whole ball up among the members.
    ball = np.array([_bits(c) for f in range(1, radius + 1) for c in combinations(range(64), f)], np.uint64) if (lengths > PAIR_RUN).any() else None
    for start, length in zip(starts[lengths > PAIR_RUN], lengths[lengths > PAIR_RUN], strict=True):
        own = np.unique(fps[start : start + length])
        spread = np.bitwise_or.reduce(own ^ own[0])
        reach = ball[(ball & ~spread) == 0]  # flips of bits in which no two members differ reach none
        if len(reach) >= len(own):
            reach = None
        for k in range(0, len(own), 256):
            part = own[k : k + 256]
            if reach is None:
                i, j = np.nonzero(np.bitwise_count(part[:, None] ^ own[None, :]) <= radius)
                a, b = part[i], own[j]
            else:
                i = np.repeat(np.arange(len(part)), len(reach))
                to = (part[:, None] ^ reach[None, :]).ravel()
                found = own[np.minimum(np.searchsorted(own, to), len(own) - 1)] == to
                a, b = part[i[found]], to[found]
            a, b = np.searchsorted(values, a), np.searchsorted(values, b)
            for rows in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1) if edges else (slice(None),):
                link(a[rows], b[rows])
    if edges:
        return tuple(np.concatenate([np.empty(0, np.uint64), *side]) for side in zip(*pairs, strict=True)) if pairs else (values[:0], values[:0])
    roots = forest.all_roots()
    own = roots != np.arange(len(values))
    return values[own], values[roots[own]]


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive runs of the given lengths."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def near_links(fps: DataFrame, radius: int = 3, blocks: int = 4, edges: bool = False) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) that join all pairs within `radius` bits; with `edges` such pairs only."""
    spark = fps.sparkSession
    variants = masks(radius, blocks)
    visible, flips = (np.array(x, np.uint64) for x in zip(*variants, strict=True))
    rows = fps.count()
    buckets = partitions(spark, rows * len(variants), TASK_VARIANTS)
    blocks_of = np.unique(visible, return_inverse=True)[1].astype(np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(every), 4096):
                fp = every[k : k + 4096]
                # Hidden bits carry the number of the block, so that variants of different blocks hardly ever meet.
                keys = _mixed((((fp[:, None] ^ flips) & visible) | (~visible & (blocks_of * np.uint64(0x0001000100010001)))).ravel())
                to = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                pairs = np.stack([keys[order], np.repeat(fp, len(flips))[order]], axis=1)
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([pairs[cuts[j] : cuts[j + 1]].tobytes() for j in used], pa.binary())], names=["bucket", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p.as_py() for batch in batches for p in batch.column(1)]
        pairs = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
        del parts
        a, b = linked(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), radius, edges)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sent = fps.select("fp").mapInArrow(released(emit), "bucket long, packed binary")
    return sent.repartition(buckets, "bucket").mapInArrow(released(meet), "a long, b long")


def _components(own: DataFrame, radius: int, blocks: int) -> DataFrame:
    """g (a fingerprint of `own`) and root, a fingerprint of its component."""
    distinct = written(own.select("fp").distinct(), "distinct")
    roots = written(connected_components(near_links(distinct, radius, blocks)), "components")
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("g"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, blocks: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs`."""
    own = written(fingerprints(docs, n).drop("hash"), "fingerprints")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    grouped = _components(own, radius, blocks).join(first, F.col("g") == F.col("fp")).select("g", "root", "first")
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    of = grouped.join(smallest, F.col("root") == F.col("r")).select("g", "component_id")
    out = own.join(of, F.col("fp") == F.col("g"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Samples of a document's shingles, shingles of each, and shingle hashes (32 bits of each) kept to sort out with.
VIEWS, SAMPLE, SKETCH = 12, 4, 64
#: How far below the least similarity an estimate may be: six standard errors of a sketch.
MARGIN = 0.3
#: How many of the most frequent shingles have a place in the order of prefixes; the others are in that of their hashes.
FREQUENT = 1 << 18
_SEEDS = np.array([xxhash.xxh64_intdigest(b"view", k) for k in range(VIEWS)], np.uint64)


def views(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of VIEWS samples of distinct shingle hashes: each of the SAMPLE lowest under its own scramble."""
    mixed = _mixed(_mixed(hashes[:, None] ^ _SEEDS[None, :]))
    if len(hashes) > SAMPLE:
        picks = hashes[np.argpartition(mixed, SAMPLE - 1, axis=0)[:SAMPLE]]
    else:
        picks = np.resize(hashes, SAMPLE)[:, None].repeat(VIEWS, axis=1)
    w, x, y, z = picks
    return (w & x & (y | z)) | ((w | x) & y & z)


def similarity(a: np.ndarray, b: np.ndarray, lowest: int | None = None) -> float:
    """Jaccard of two sets of hashes, or its estimate from their `lowest` ones."""
    union = np.union1d(a, b)[:lowest]
    shared = np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)
    return len(shared) / len(union) if len(union) else 0.0


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, hash (of the text), fp, size (distinct shingles), views and sketch (lowest hashes) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, own, kept = np.empty(batch.num_rows, np.uint64), [], [], []
            for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
                made = hashes_of(text.as_py() or b"", n)
                fps[k] = majority(made)
                distinct = np.unique(made)
                sizes.append(len(distinct))
                own.append(views(distinct).view(np.int64) if len(distinct) else np.empty(0, np.int64))
                kept.append(np.unique((distinct[:SKETCH] >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "hash", "fp", "size", "views", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash")).mapInArrow(released(run), "doc_id long, hash long, fp long, size long, views array<long>, sketch binary")


def _similar_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b) of nodes (hash, root, size, views, sketch) that share a sample's fingerprint, have different roots and may be similar enough.

    Sets of a similarity s differ in size by the factor s at most, so a node goes to two of the classes of
    such a factor. In each group of a sample's fingerprint and a class all members are compared with two
    of them, others in each group; a group of common passages thus splits by size, and costs two
    comparisons a member. What is lost here is found by the prefix join. Sketches only sort out.
    """
    klass = F.floor(F.log(F.col("size").cast("double")) / -float(np.log(least)))
    each = nodes.where("size > 0").select("hash", "root", F.posexplode("views").alias("view", "key"), klass.alias("class")).select("hash", "root", "view", "key", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    group = F.xxhash64("view", "key", "class")
    each = each.select("hash", "root", group.alias("group"))
    draw = F.struct(F.xxhash64("hash", "group"), "hash", "root")
    ends = each.groupBy("group").agg(F.min(draw).alias("x"), F.max(draw).alias("y"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    ends = ends.select(F.col("group").alias("g"), F.explode(F.array("x", "y")).alias("end")).select("g", F.col("end.hash").alias("a"), F.col("end.root").alias("a_root"))
    pairs = each.join(ends, (F.col("group") == F.col("g")) & (F.col("root") != F.col("a_root"))).select(F.least("a", "hash").alias("a"), F.greatest("a", "hash").alias("b")).distinct()
    return written(pairs, "candidates")


def _sorted_out(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) without those whose sketches are farther below `least` than MARGIN."""

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([similarity(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), SKETCH) for x, y in zip(batch.column(2), batch.column(3), strict=True)])
            good = pa.array(found >= least - MARGIN, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda c: nodes.select(F.col("hash").alias(f"{c}_node"), F.col("sketch").alias(f"{c}_sketch"))
    met = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    return written(met.select("a", "b", "a_sketch", "b_sketch").mapInArrow(released(sort_out), "a long, b long"), "left")


def exact(pairs: DataFrame, docs: DataFrame, n: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of text hashes whose texts have a Jaccard of `least` or more, by all their shingles."""
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(hashes_of(t.as_py() or b"", n)).tobytes() for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["hash", "set"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    texts = docs.select(F.xxhash64("text").alias("hash"), "text").join(wanted, F.col("hash") == F.col("w"), "left_semi")
    sets = written(texts.mapInArrow(released(run), "hash long, set binary").dropDuplicates(["hash"]), "sets")
    side = lambda c: sets.select(F.col("hash").alias(f"{c}_node"), F.col("set").alias(f"{c}_set"))
    met = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    out = written(met.select("a", "b", "a_set", "b_set").mapInArrow(released(verify), "a long, b long"), "exact")
    discard(sets)
    return out


def prefixes(distinct: np.ndarray, often: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The shingle hashes that a text is found by, rarest first; `often` has sorted hashes and their counts."""
    size = len(distinct)
    keys, counts = often
    at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
    seen = np.where(keys[at] == distinct, counts[at], 0) if len(keys) else np.zeros(size, np.int64)
    return distinct[np.lexsort((distinct, seen))[: size - int(np.ceil(least * size - 1e-9)) + 1]]


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes that are in most texts of a sample, and in how many. They only order the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes_of(text.as_py() or b"", n)).view(np.int64))], names=["token"])

    made = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text").mapInArrow(released(run), "token long").groupBy("token").agg(F.count("*").alias("c")).where("c > 2")
    found = made.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    keys, counts = found["token"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _prefix_entries(docs: DataFrame, nodes: DataFrame, n: int, least: float) -> DataFrame:
    """token, hash, size, at: the shingles that texts are found by, as far as two texts have them."""
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(frequent(docs, n))
    entries = int((nodes.agg(F.sum("size").alias("n")).first().n or 0) * (1 - least))
    buckets = partitions(spark, entries, TASK_VARIANTS // 2)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            made = []
            for text, own in zip(batch.column(0).cast(pa.large_binary()), batch.column(1).to_numpy(), strict=True):
                if own in done:
                    continue
                done.add(own)
                distinct = np.unique(hashes_of(text.as_py() or b"", n))
                if len(distinct):
                    first = prefixes(distinct, often.value, least)
                    rows = np.empty((len(first), 3), np.uint64)
                    rows[:, 0], rows[:, 1] = first, np.int64(own).view(np.uint64)
                    rows[:, 2] = (np.uint64(len(distinct)) << np.uint64(32)) | np.arange(len(first), dtype=np.uint64)
                    made.append(rows)
            if made:
                rows = np.concatenate(made)
                to = (_mixed(rows[:, 0]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                rows, used = rows[order], np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([rows[cuts[j] : cuts[j + 1]].tobytes() for j in used], pa.binary())], names=["bucket", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p.as_py() for batch in batches for p in batch.column(1)]
        rows = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 3)
        del parts
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        # Copies that several tasks have sent are one; shingles of one text alone find nothing.
        rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows
        same = rows[1:, 0] == rows[:-1, 0]
        rows = rows[np.r_[False, same] | np.r_[same, False]] if len(rows) else rows
        for k in range(0, len(rows), 100_000):
            part = rows[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(part[:, c]).view(np.int64)) for c in (0, 1)), pa.array((part[:, 2] >> np.uint64(32)).astype(np.int64)), pa.array((part[:, 2] & np.uint64(0xFFFFFFFF)).astype(np.int64))], names=["token", "hash", "size", "at"])

    sent = docs.select("text", F.xxhash64("text").alias("hash")).mapInArrow(released(emit), "bucket long, packed binary")
    return written(sent.repartition(buckets, "bucket").mapInArrow(released(meet), "token long, hash long, size long, at long"), "shared")


def _mixed_entries(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of tokens that texts of different groups (node, root) have, with their root."""
    shared = entries.join(groups, F.col("hash") == F.col("node"), "left").select("token", "hash", "size", "at", F.coalesce("root", "hash").alias("root"))
    mixed = shared.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("token").alias("t"))
    return written(shared.join(mixed, F.col("token") == F.col("t"), "left_semi"), "mixed")


def _enough(least: float) -> Column:
    """At a token that x and another text share, what is left of both does for the overlap."""
    return F.least(F.col("x_size") - F.col("x_at"), F.col("size") - F.col("at")) >= (F.col("x_size") + F.col("size")) * (least / (1 + least)) - 1e-9


def _hub_pairs(entries: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(a, b) of texts with the hub of each of their tokens: the text with the fewest shingles that come before it.

    A hub has the least of its own, so that texts near one another are likely to be near it. This is one comparison an
    entry at most, and what it joins is left out of the prefix join, which finds all that is lost here.
    """
    shared = _mixed_entries(entries, groups)
    hubs = shared.groupBy("token").agg(F.min(F.struct(F.col("at") / F.col("size"), F.col("hash").alias("x_hash"), F.col("size").alias("x_size"), F.col("at").alias("x_at"), F.col("root").alias("x_root"))).alias("hub"))
    hubs = hubs.select(F.col("token").alias("x_token"), "hub.x_hash", "hub.x_size", "hub.x_at", "hub.x_root")
    fits = (F.col("x_root") != F.col("root")) & (F.least("x_size", "size") >= F.greatest("x_size", "size") * least - 1e-9)
    met = shared.join(hubs, (F.col("token") == F.col("x_token")) & fits & _enough(least))
    pairs = written(met.select(F.least("x_hash", "hash").alias("a"), F.greatest("x_hash", "hash").alias("b")).distinct(), "hubs")
    discard(shared)
    return pairs


def _prefix_pairs(entries: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(a, b) of all texts' hashes that may have a Jaccard of `least` and are in different groups (node, root).

    With all shingles in one order, a text x that has no more shingles than y shares, if they are similar
    enough, one of its first |x| - ceil(2t/(1+t)|x|) + 1 with the first |y| - ceil(t|y|) + 1 of y. At
    the first that they share, what is left of both must do for the overlap. No pair is lost by this.
    Rare shingles come first, so a passage of many texts is looked at only in texts of little else.
    """
    shared = _mixed_entries(entries, groups)
    x = shared.where(F.col("at") < F.col("size") - F.ceil(F.col("size") * (2 * least / (1 + least)) - 1e-9) + 1).select(*(F.col(c).alias(f"x_{c}") for c in shared.columns))
    fits = (F.col("x_root") != F.col("root")) & (F.col("x_size") <= F.col("size")) & (F.col("x_size") >= F.col("size") * least - 1e-9)
    met = shared.join(x, (F.col("token") == F.col("x_token")) & fits & _enough(least))
    pairs = written(met.select(F.least("x_hash", "hash").alias("a"), F.greatest("x_hash", "hash").alias("b")).distinct(), "pairs")
    discard(shared)
    return pairs


def _bit_pairs(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b) of nodes (hash, fp) with one fingerprint, each with the first of them, and of the first of fingerprints that are near.

    Each fingerprint is paired with the smallest and the greatest that it is known to be near, so pairs are no more than twice the nodes.
    """
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.groupBy("a").agg(F.array(F.min("b"), F.max("b")).alias("b")).select("a", F.explode("b").alias("b"))
    near = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    lead = nodes.groupBy("fp").agg(F.min("hash").alias("lead")).withColumnRenamed("fp", "f")
    same = nodes.join(lead, F.col("fp") == F.col("f")).where("hash <> lead").select(F.col("lead").alias("a"), F.col("hash").alias("b"))
    side = lambda c: lead.select(F.col("f").alias(f"{c}_fp"), F.col("lead").alias(f"{c}_lead"))
    across = near.join(side("a"), F.col("a") == F.col("a_fp")).join(side("b"), F.col("b") == F.col("b_fp"))
    return same.unionByName(across.select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b")))


def keep_one(docs: DataFrame, n: int = 5, radius: int = 3, blocks: int = 4, least: float = 0.8) -> DataFrame:
    """The rows of `docs` that stay: of each group of near-duplicates the one with the smallest doc_id (null last), ties by a hash of its text.

    Texts link if they share `least` of their distinct shingles (Jaccard), and every link is verified by
    all shingles of both. Candidates come cheaply first: fingerprints within `radius` bits, which finds texts that
    share nearly all shingles, and, as texts at `least` differ in some ten of 64 bits and no ball of that
    size can be emitted, fingerprints of samples of a few shingles. This joins most groups at a few
    comparisons a text; sketches sort out pairs that are far from similar. Then texts with a shingle are compared with
    its hub. A prefix join at last finds every pair of texts in different groups that may be similar enough, and they are verified too.

    Of repeated rows one stays. Only rows that go, or that are repeated, are looked up among the texts, so
    that texts are shuffled only where those are too many to be sent around. Null and empty texts and those without words are one
    group; very long texts are hashed whole; columns may have any names, and an empty table stays empty.
    """
    own = written(sketches(docs, n), "sketches")
    distinct = written(own.select("fp").distinct(), "distinct")
    near = written(near_links(distinct, radius, blocks, edges=True), "bits")
    found = written(connected_components(near), "components")
    # Nodes of one component of fingerprints hang on the smallest of them: views needn't compare them.
    roots = distinct.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("g"), F.coalesce("root", "fp").alias("root"))
    smallest = own.select("hash", "fp").distinct().join(roots, F.col("fp") == F.col("g")).groupBy("root").agg(F.min("hash").alias("least")).withColumnRenamed("root", "r")
    rooted = own.dropDuplicates(["hash"]).join(roots, F.col("fp") == F.col("g")).join(smallest, F.col("root") == F.col("r"))
    nodes = written(rooted.select("hash", "fp", F.col("least").alias("root"), "size", "views", "sketch"), "nodes")
    rows = written(own.select("doc_id", "hash"), "rows")
    for table in (own, distinct, found):
        discard(table)
    candidates = _similar_pairs(nodes, least)
    judged = written(candidates.unionByName(_bit_pairs(nodes.where("size > 0"), near)).distinct(), "judged")
    left = _sorted_out(judged, nodes, least)
    empty = nodes.where("size = 0").select("hash")
    void = empty.join(empty.agg(F.min("hash").alias("a"))).where("a <> hash").select("a", F.col("hash").alias("b"))
    verified = exact(left, docs, n, least)
    links = written(verified.unionByName(void), "near")
    for table in (near, candidates, left, verified):
        discard(table)
    parts = written(connected_components(links), "found")
    entries = _prefix_entries(docs, nodes, n, least)
    for find in (_hub_pairs, _prefix_pairs):
        pairs = find(entries, parts, least)
        # What was judged before isn't judged again.
        before = judged.select(F.col("a").alias("x"), F.col("b").alias("y"))
        fresh = pairs.join(before, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")
        left = _sorted_out(fresh, nodes, least)
        more = exact(left, docs, n, least)
        links, judged = links.unionByName(more), judged.unionByName(pairs)
        parts = written(connected_components(links), "groups")
        discard(left)
    grouped = rows.join(parts, F.col("hash") == F.col("node"), "left").withColumn("group", F.coalesce("root", "hash"))
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("group").alias("g"), "first.doc_id", "first.hash")
    met = grouped.select("doc_id", "hash", "group").join(first.select("g", F.col("doc_id").alias("first_id"), F.col("hash").alias("first_hash")), F.col("group") == F.col("g"))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    # A row is known by its doc_id and the hash of its text.
    keys = met.groupBy("doc_id", "hash").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1")
    keys = written(keys.select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash"), "stays"), "gone")
    for table in (rows, nodes, entries):
        discard(table)
    every = docs.select(F.col("doc_id").cast("long").alias("key_id"), F.xxhash64("text").alias("key_hash"), packed(docs).alias("row"))
    same = F.col("key_id").eqNullSafe(F.col("gone_id")) & (F.col("key_hash") == F.col("gone_hash"))
    alone = every.join(keys, same, "left_anti")
    again = every.join(keys.where("stays"), same, "left_semi").dropDuplicates(["key_id", "key_hash"])
    return alone.unionByName(again).select("row.*")
