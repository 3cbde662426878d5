"""A full-text index as tables: blocks of postings by term, and a search that leaves out what can't be among the best.

A task cuts its documents, by length, into stripes of a few, and turns each stripe's words into blocks: a row for each
term of a stripe, with ids, counts and lengths of the documents that have it. A block's head tells how much
a document in it can gain at most (its highest count, its shortest length) and what one of them does
gain; neither depends on statistics that change as documents come and go. A row without a term
has all documents of a stripe. Rows are stored in one folder for each bucket of term hashes, sorted by term: a question
reads the buckets and the columns that it needs.

A block belongs to one stripe and so has few postings however frequent its term is. No term's postings meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lexical import DIGITS, K1, B

#: Documents in a stripe, tokens that a task holds before it cuts stripes, buckets of terms, and the bucket of documents.
STRIPE, HELD, BUCKETS, DOCUMENTS = 128, 1 << 20, 32, -1
#: Terms up to which a question's terms are also sent to the file reader as a filter.
PUSHED = 1000
#: Stripes that are scored first, in order to know how good the k-th best is at least.
FIRST = 8
#: Up to so many stripes best() opens all: that is less work than to prove which needn't be.
FEW = 2048


def schema_of(kind: str) -> str:
    """The columns of a block for ids of a type."""
    return f"term string, stripe long, n int, total long, most int, shortest int, lead_tf int, lead_length int, ids array<{kind}>, tfs array<int>, lengths array<int>"


NAMES = [c.split()[0] for c in schema_of("x").split(", ")]


def _cut(batches: list[pa.RecordBatch], base: int, stripe: int) -> Iterator[pa.RecordBatch]:
    """The blocks and the document rows of a few batches of (id, tokens)."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
    begins = lists.offsets.to_numpy()
    lengths = np.where(np.asarray(lists.is_null()), 0, np.diff(begins))
    order = np.argsort(lengths, kind="stable")
    ids, lengths, n = ids.take(pa.array(order)), lengths[order], len(order)
    words = lists.values.take(pa.array(np.repeat(begins[:-1][order], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)))
    coded = words.dictionary_encode()
    doc, real = np.repeat(np.arange(n), lengths), np.asarray(words.is_valid())
    code, size = coded.indices.fill_null(0).to_numpy()[real].astype(np.int64), max(1, len(coded.dictionary))
    found, tf = np.unique(((doc[real] // stripe) * size + code) * n + doc[real], return_counts=True)
    doc, group = found % n, found // n
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    own = lengths[doc]
    gain = tf / (tf + K1 * (1 - B + B * own / max(lengths.mean(), 1)))
    lead = np.lexsort((-gain, group))[first]
    ints = lambda x: pa.array(np.asarray(x, np.int32))
    if len(first):
        cuts = np.r_[first, len(found)]
        listed = lambda x: pa.ListArray.from_arrays(ints(cuts), x)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(group[first] % size)).cast(pa.string()), pa.array(base + group[first] // size), ints(np.diff(cuts)), pa.array(np.add.reduceat(tf, first)), ints(np.maximum.reduceat(tf, first)), ints(np.minimum.reduceat(own, first)), ints(tf[lead]), ints(own[lead]), listed(ids.take(pa.array(doc))), listed(ints(tf)), listed(ints(own))], names=NAMES)
    cuts = np.r_[np.arange(0, n, stripe), n]
    listed = lambda x: pa.ListArray.from_arrays(ints(cuts), x)
    none = pa.nulls(len(cuts) - 1, pa.int32())
    yield pa.RecordBatch.from_arrays([pa.nulls(len(cuts) - 1, pa.string()), pa.array(base + np.arange(len(cuts) - 1)), ints(np.diff(cuts)), pa.array(np.add.reduceat(lengths, cuts[:-1]).astype(np.int64)), none, none, none, none, listed(ids), listed(ints(np.zeros(n))), listed(ints(lengths))], names=NAMES)


def invert(docs: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """The blocks of `docs` (id, tokens); null lists are empty, null tokens count in the length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, tokens, rows = TaskContext.get().partitionId() << 40, [], 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 8 * stripe):
                part = batch.slice(k, 8 * stripe)
                held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], names=["id", "tokens"]))
                tokens, rows = tokens + len(part.column(1).flatten()), rows + part.num_rows
                if tokens >= HELD:
                    yield from _cut(held, base, stripe)
                    base, held, tokens, rows = base + -(-rows // stripe), [], 0, 0
        if rows:
            yield from _cut(held, base, stripe)

    return docs.select("id", "tokens").mapInArrow(run, schema_of(docs.schema["id"].dataType.simpleString()))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(term), F.lit(buckets)), F.lit(DOCUMENTS)).cast("int")


def write(docs: DataFrame, path: str, buckets: int = BUCKETS, stripe: int = STRIPE) -> None:
    """Index `docs` (id, tokens) into the folder `path`, a folder for each bucket."""
    made = invert(docs, stripe).withColumn("bucket", F.when(F.col("term").isNull(), DOCUMENTS).otherwise(bucket_of(F.col("term"), buckets)))
    # Rebalancing splits the bucket of a frequent term over several tasks.
    made.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "stripe").write.partitionBy("bucket").parquet(path)


@dataclass
class Postings:
    """An index in the segment folders `segments` below `root`; `dead` has (segment, id) of what is deleted in each."""

    spark: SparkSession
    root: str
    segments: list[str]
    kind: str = "bigint"
    buckets: int = BUCKETS
    dead: DataFrame | None = None
    k1: float = K1
    b: float = B
    _totals: tuple[int, int, int] | None = None

    @classmethod
    def built(cls, docs: DataFrame, root: str, **options) -> Postings:
        """An index of one segment made of `docs` (id, tokens)."""
        write(docs, f"{root}/segment=0", options.get("buckets", BUCKETS))
        return cls(docs.sparkSession, root, ["0"], docs.schema["id"].dataType.simpleString(), **options)

    @property
    def rows(self) -> DataFrame:
        """All blocks and document rows, with their segment and bucket."""
        schema = f"{schema_of(self.kind)}, segment string, bucket int"
        if not self.segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*(f"{self.root}/segment={s}" for s in self.segments))

    @property
    def totals(self) -> tuple[int, int, int]:
        """Documents, their total length, and stripes; deleted ones included."""
        if self._totals is None:
            row = self.rows.where(F.col("bucket") == DOCUMENTS).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("stripes")).first()
            self._totals = (row.n or 0, row.total or 0, row.stripes)
        return self._totals

    def documents(self) -> DataFrame:
        """segment, id, length of every document that is not deleted."""
        each = self.rows.where(F.col("bucket") == DOCUMENTS).select("segment", F.explode(F.arrays_zip("ids", "lengths")).alias("d")).select("segment", F.col("d.ids").alias("id"), F.col("d.lengths").alias("length"))
        return self._alive(each)

    def _alive(self, each: DataFrame) -> DataFrame:
        if self.dead is None:
            return each
        gone = self.dead.select(F.col("segment").alias("s"), F.col("id").alias("gone"))
        return each.join(gone, (F.col("segment") == F.col("s")) & (F.col("id") == F.col("gone")), "left_anti")

    def statistics(self, allowed: DataFrame | None = None) -> tuple[int, float]:
        """Number and mean length of the documents; `allowed` (id) limits them."""
        if self.dead is None and allowed is None:
            n, total, _ = self.totals
            return n, total / max(n, 1)
        docs = self.documents() if allowed is None else self.documents().join(allowed, "id", "left_semi")
        row = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        return row.n, row.mean or 0.0

    def blocks(self, terms: DataFrame) -> DataFrame:
        """The blocks of the terms of `terms` (query_id, term); only their buckets are read.

        What a caller asks at once is small; the list of buckets is bounded by their number.
        """
        asked = terms.where("term IS NOT NULL").select("term", bucket_of(F.col("term"), self.buckets).alias("bucket")).distinct()
        few = asked.limit(PUSHED + 1).collect()
        if len(few) <= PUSHED:
            return self.rows.where(F.col("bucket").isin([*{r.bucket for r in few}]) & F.col("term").isin([r.term for r in few]))
        own = [r.bucket for r in asked.select("bucket").distinct().collect()]
        return self.rows.where(F.col("bucket").isin(own)).join(asked.select("term"), "term", "left_semi")

    def _gain(self, tf: str, length: str) -> Column:
        return F.col(tf) * (self.k1 + 1) / (F.col(tf) + self.k1 * (1 - self.b + self.b * F.col(length) / F.col("mean")))

    def _idf(self, df: DataFrame, n: int, mean: float) -> DataFrame:
        """t, mean and idf of (term, df): ln(1 + (N - df + 0.5) / (df + 0.5))."""
        return df.select(F.col("term").alias("t"), F.lit(float(mean)).alias("mean"), F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def postings(self, blocks: DataFrame) -> DataFrame:
        """segment, term, id, tf, length of the documents in blocks that are not deleted."""
        each = blocks.select("segment", "term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
        return self._alive(each.select("segment", "term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length")))

    def scores(self, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, id, score of every document that shares a term with a query, for `terms` (query_id, term).

        With `allowed` (id) only those documents exist, for the statistics too.
        """
        terms = terms.distinct()
        blocks = self.blocks(terms)
        each = self.postings(blocks)
        if allowed is not None:
            each = each.join(allowed, "id", "left_semi")
        whole = self.dead is None and allowed is None
        df = blocks.groupBy("term").agg(F.sum("n").alias("df")) if whole else each.groupBy("term").agg(F.count("*").alias("df"))
        idf = self._idf(df, *self.statistics(allowed))
        return self._summed(each.join(idf, F.col("term") == F.col("t")), terms)

    def _summed(self, each: DataFrame, terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        part = each.select(*by, "id", "term", (F.col("idf") * self._gain("tf", "length")).alias("part"))
        asked = terms.select(F.col("query_id").alias("q"), F.col("term").alias("asked"))
        of = (F.col("term") == F.col("asked")) & (F.col("q") == F.col("query_id")) if by else F.col("term") == F.col("asked")
        met = part.join(asked, of)
        return met.groupBy(F.col("q").alias("query_id"), "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))

    def best(self, terms: DataFrame, k: int, few: int = FEW) -> DataFrame:
        """query_id, id, score of at least the k best documents of each query, and all ties; exact.

        The heads of all blocks bound each stripe. The stripes with the highest bounds are scored first; the k-th best of their
        documents, or of the documents that heads vouch for, is the score that others must reach. Only stripes whose bound reaches
                it are opened. With deletions, whose statistics heads don't know, and in a small index every posting of the terms is scored.
        """
        if self.dead is not None or self.totals[2] <= few:
            return self.scores(terms)
        plan = self.plan(terms, k)
        return plan.opened.unionByName(self._opened(plan.rest, plan))

    def plan(self, terms: DataFrame, k: int) -> Plan:
        """What best() opens, in two steps."""
        terms = terms.where("term IS NOT NULL").distinct()
        blocks = self.blocks(terms)
        heads = blocks.select("segment", "term", "stripe", "n", "most", "shortest", "lead_tf", "lead_length")
        idf = self._idf(heads.groupBy("term").agg(F.sum("n").alias("df")), *self.statistics())
        each = heads.join(idf, F.col("term") == F.col("t")).select("segment", "stripe", "term", (F.col("idf") * self._gain("most", "shortest")).alias("most"), (F.col("idf") * self._gain("lead_tf", "lead_length")).alias("least"))
        bounds = each.join(terms, "term").groupBy("query_id", "segment", "stripe").agg(F.sum("most").alias("most"), F.max("least").alias("least"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "segment", "stripe"))
        first = bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("query_id", "segment", "stripe")
        made = Plan(terms, blocks, idf, bounds, first)
        made.opened = self._opened(first, made)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        kth = lambda rows: rows.withColumn("place", nth).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", "score")
        reach = kth(bounds.select("query_id", F.col("least").alias("score"))).unionByName(kth(made.opened.select("query_id", "score"))).groupBy(F.col("query_id").alias("q")).agg(F.max("score").alias("reach"))
        open_ = bounds.join(reach, F.col("query_id") == F.col("q"), "left").where(F.col("reach").isNull() | (F.col("most") >= F.col("reach") - 2 * 10.0**-DIGITS))
        made.rest = open_.select("query_id", "segment", "stripe").join(first, ["query_id", "segment", "stripe"], "left_anti")
        return made

    def _opened(self, stripes: DataFrame, plan: Plan) -> DataFrame:
        """query_id, id, score of the documents of stripes (query_id, segment, stripe)."""
        own = stripes.select("query_id", F.col("segment").alias("s"), F.col("stripe").alias("o"))
        blocks = plan.blocks.join(own, (F.col("segment") == F.col("s")) & (F.col("stripe") == F.col("o")))
        each = blocks.select("query_id", "term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
        each = each.select("query_id", "term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
        return self._summed(each.join(plan.idf, F.col("term") == F.col("t")), plan.terms, ("query_id",))


@dataclass
class Plan:
    """terms; their blocks and idf; the bounds of all stripes; those opened first, with their scores, and those opened then."""

    terms: DataFrame
    blocks: DataFrame
    idf: DataFrame
    bounds: DataFrame
    first: DataFrame
    opened: DataFrame | None = None
    rest: DataFrame | None = None
