"""Incremental state: manifests, last writes, guards and upserts, usage counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write_wins(log: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each key the row written last; as an aggregation, so a hot key is combined before the shuffle."""
    row = F.struct(*log.columns)
    return log.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def manifest_diff(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """rel_path, action of disk (rel_path, hash) against manifest (rel_path, hash, status): added, updated, skipped, retried or removed."""
    m = manifest.select(F.col("rel_path").alias("m_path"), F.col("hash").alias("m_hash"), "status")
    action = (
        F.when(F.col("m_path").isNull(), "added")
        .when(F.col("rel_path").isNull(), "removed")
        .when((F.col("hash") == F.col("m_hash")) & (F.col("status") == "ok"), "skipped")
        .when(F.col("status") == "failed", "retried")
        .otherwise("updated")
    )
    return disk.join(m, F.col("rel_path") == F.col("m_path"), "full_outer").select(F.coalesce("rel_path", "m_path").alias("rel_path"), action.alias("action"))


def purgeable(stale: DataFrame, manifest: DataFrame) -> DataFrame:
    """The stale entries (rel_path, source_key) whose source no other path still has."""
    other = manifest.select(F.col("rel_path").alias("o_path"), F.col("source_key").alias("o_key"))
    return stale.join(other, (F.col("source_key") == F.col("o_key")) & (F.col("rel_path") != F.col("o_path")), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those with their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` and those rows of `new` whose key it doesn't have; what is there stays."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"))


COUNTERS = ("prompt_tokens", "completion_tokens", "cached_tokens", "llm_calls", "cache_hits", "parse_failures", "dangling_citations", "metadata_incomplete")


def usage_total(readings: DataFrame, *by: str, seq: str = "seq") -> DataFrame:
    """Usage readings merged: counters added, cost known only if all are, the currency of the first reading that says something (a known cost before unknown ones)."""
    some = sum((F.col(c) for c in COUNTERS), F.col("estimated_cost")) != 0
    rank = F.struct((~F.col("cost_known")).cast("int").alias("unknown"), F.col(seq))
    return readings.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.sum("estimated_cost").alias("estimated_cost"),
        F.bool_and("cost_known").alias("cost_known"),
        F.coalesce(F.min_by(F.when(some, F.col("cost_currency")), F.when(some, rank)), F.max_by("cost_currency", F.col(seq))).alias("cost_currency"),
    )


def cost(cached: Column, uncached: Column, completion: Column, price_in: float, price_cached: float | None, price_out: float) -> Column:
    """Prices are for a million tokens; without a price for cached tokens they cost what others do."""
    return cached / 1e6 * (price_cached if price_cached is not None else price_in) + uncached / 1e6 * price_in + completion / 1e6 * price_out


def deltas(readings: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """Each cumulative reading less the one before it."""
    return readings.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(Window.partitionBy(by).orderBy(order)))


def streak(rows: DataFrame, gain: Column, by: str, order: str) -> DataFrame:
    """How many rows in a row, up to each, brought no gain."""
    w = Window.partitionBy(by).orderBy(order)
    block = F.sum(gain.cast("int")).over(w)
    return rows.withColumn("_block", block).withColumn("streak", F.sum((~gain).cast("int")).over(Window.partitionBy(by, "_block").orderBy(order))).drop("_block")


def islands(pairs: DataFrame, by: tuple[str, ...], left: str, right: str, least: int = 2) -> DataFrame:
    """Runs in which both line numbers rise by one: `by`, length, start of both; runs of `least` and more."""
    shifted = pairs.select(*by, left, right).distinct().withColumn("_delta", F.col(right) - F.col(left))
    place = F.col(left) - F.row_number().over(Window.partitionBy(*by, "_delta").orderBy(left))
    runs = shifted.withColumn("_run", place).groupBy(*by, "_delta", "_run").agg(F.count("*").alias("length"), F.min(left).alias(f"{left}_start"), F.min(right).alias(f"{right}_start"))
    return runs.where(F.col("length") >= least).drop("_delta", "_run")
