"""A table with one row for each key, in buckets that are written anew when a key of theirs changes.

Rows lie in a folder for each version and bucket; a version lists which folder each bucket is in. A change reads and writes the
buckets of its keys only, and becomes visible in one step. A change with one invalid row is refused as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import SCHEMA_VERSION, Store


class Refused(ValueError):
    """A change that isn't made; names the first bad keys."""


class KeyedTable(Store):
    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int = 16, fault: Callable[[], Column] | None = None):
        """`fault` makes a column that says what is wrong with a row, or is null."""
        super().__init__(spark, root)
        self.key, self.schema, self.buckets, self.fault = key, schema, buckets, fault

    def folders(self) -> dict[int, str]:
        """The version that holds each bucket."""
        version = self.current()
        if version is None:
            return {}
        found = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/versions/{version}.json").collect()))
        if found["buckets"] != self.buckets:
            raise ValueError(f"the table has {found['buckets']} buckets, not {self.buckets}")
        return {int(b): v for b, v in found["folders"].items()}

    def _at(self, folders: dict[int, str], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/rows/version={v}/bucket={b}" for b, v in sorted(folders.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return self.spark.read.schema(f"{self.schema}, version string, bucket int").option("basePath", f"{self.root}/rows").parquet(*paths).drop("version")

    def read(self) -> DataFrame:
        return self._at(self.folders()).drop("bucket")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def checked(self, batch: DataFrame) -> DataFrame:
        """The batch as rows of the table; raises if a row is invalid, or a key is null or there twice."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows = batch.select(*names)
        fault = F.when(F.col(self.key).isNull(), "no key")
        if self.fault is not None:
            fault = F.coalesce(fault, self.fault())
        bad = rows.select(F.col(self.key).alias("k"), fault.alias("fault")).where("fault IS NOT NULL")
        twice = rows.groupBy(F.col(self.key).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k", F.lit("there twice").alias("fault"))
        found = bad.unionByName(twice).orderBy("k", "fault").limit(5).collect()
        if found:
            raise Refused("; ".join(f"{r.k}: {r.fault}" for r in found))
        return rows

    def upsert(self, batch: DataFrame) -> str:
        """Put the rows of `batch` in place of those with their keys, and beside the others; the new version."""
        return self._change(self.checked(batch).withColumn("bucket", self._bucket(self.key)), batch)

    def delete(self, keys: DataFrame) -> str:
        """Remove the rows with the keys of `keys`; keys that no row has do nothing."""
        return self._change(None, keys)

    def _change(self, new: DataFrame | None, keys: DataFrame) -> str:
        before, folders, version = self.current(), self.folders(), self.begin()
        gone = keys.select(F.col(self.key).alias("gone")).distinct()
        touched = sorted(r.bucket for r in gone.select(self._bucket("gone").alias("bucket")).distinct().collect())
        rows = self._at(folders, touched).join(gone, F.col(self.key) == F.col("gone"), "left_anti")
        if new is not None:
            rows = rows.unionByName(new)
        path = f"{self.root}/rows/version={version}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
        written = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._path(path)) if f.isDirectory()}
        made = {b: v for b, v in folders.items() if b not in touched} | dict.fromkeys(written, version)
        if self.current() != before:
            raise RuntimeError("another change was made meanwhile")
        stream = self._fs.create(self._path(f"{self.root}/versions/{version}.json"), True)
        stream.write(bytearray(json.dumps({"schema": SCHEMA_VERSION, "buckets": self.buckets, "folders": made}).encode()))
        stream.close()
        self.commit(version)
        return version
