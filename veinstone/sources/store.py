"""Versioned tables of an index: written beside the old ones, then made current in one step.

The file CURRENT names the version that readers take. It is replaced by a rename, so that a reader sees the old
version or the new one, and a failed build neither. On an object store, where a rename is a copy, the pointer is one
small object: readers see the old one or the new one there too.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession

SCHEMA_VERSION = 1


def fingerprint(settings: dict) -> str:
    """The part of a path that stands for the settings which an index depends on."""
    canonical = json.dumps({"schema": SCHEMA_VERSION, **settings}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(canonical.encode()).hexdigest()[:12]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def current(self) -> str | None:
        """The version in force; None if there is none, or it has another schema, or its name can't be read."""
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return None
        try:
            found = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/CURRENT").collect()))
            return found["version"] if found["schema"] == SCHEMA_VERSION else None
        except (ValueError, KeyError, TypeError):
            return None

    def begin(self) -> str:
        return f"v-{uuid.uuid4().hex[:12]}"

    def commit(self, version: str) -> None:
        """Make `version` the current one."""
        stream = self._fs.create(self._path(f"{self.root}/CURRENT.{version}"), True)
        stream.write(bytearray(json.dumps({"version": version, "schema": SCHEMA_VERSION}).encode()))
        stream.close()
        # Renamed over the old one in one step: readers find the old version or the new one at any time.
        jvm = self.spark._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        at = self._path(f"{self.root}/CURRENT.{version}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        context.rename(self._fs.makeQualified(at), self._fs.makeQualified(self._path(f"{self.root}/CURRENT")), options)
