"""JSON over HTTP as a Spark data source: a row for each key, fetched in partitions of keys.

    spark.dataSource.register(RestSource)
    spark.read.format("rest").option("url", "https://host/works/{key}").option("keys", json.dumps(keys)).load()

gives key, status, body and error. A failure is a row with a typed error ("NotFound: ...") and costs its key only. Failures that may
pass are tried again; 4xx are not, but for those that ask for it. Each partition keeps to its share of the rate. fetched()
does the same for keys that are rows of a table, however many.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import retry

ROWS = "key string, status int, body string, error string"
#: Names of failures by status; others of 400 and more are ClientError or ServerError.
KINDS = {400: "BadRequest", 401: "Unauthorized", 403: "Forbidden", 404: "NotFound", 410: "Gone", 429: "RateLimited"}


class HttpError(RuntimeError):
    def __init__(self, status: int, words: str):
        super().__init__(words)
        self.status = status

    @property
    def kind(self) -> str:
        return KINDS.get(self.status, "ClientError" if self.status < 500 else "ServerError")


class Endpoint(NamedTuple):
    """`url` has {key}; `per_second` is the rate of all partitions together, 0 without limit."""

    url: str
    timeout_s: float = 10.0
    attempts: int = 3
    first_wait_s: float = 0.5
    per_second: float = 0.0
    headers: tuple[tuple[str, str], ...] = (("Accept", "application/json"),)


def one(endpoint: Endpoint, key: str) -> tuple[int, str]:
    """Status and body of one request; a key's slashes stay, as those of a DOI must, and all else is quoted. Raises HttpError, TimeoutError or OSError."""
    request = urllib.request.Request(endpoint.url.replace("{key}", urllib.parse.quote(key, safe="/")), headers=dict(endpoint.headers))
    if urllib.parse.urlsplit(request.full_url).scheme not in ("http", "https"):
        raise ValueError("only http and https")
    try:
        with urllib.request.urlopen(request, timeout=endpoint.timeout_s) as reply:  # noqa: S310
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        raise HttpError(error.code, str(error.reason)) from None
    except urllib.error.URLError as error:
        raise ConnectionError(f"connection: {error.reason}") from None


class Session:
    """Requests of one partition, at most `per_second` of them."""

    def __init__(self, endpoint: Endpoint, partitions: int):
        self.endpoint, self.gap, self.next = endpoint, partitions / endpoint.per_second if endpoint.per_second else 0.0, 0.0

    def row(self, key: str | None) -> tuple[str | None, int | None, str | None, str | None]:
        if key is None or not key.strip():
            return key, None, None, "NoKey"

        def call() -> tuple[int, str]:
            time.sleep(max(0.0, self.next - time.monotonic()))
            self.next = time.monotonic() + self.gap
            return one(self.endpoint, key)

        try:
            status, body = retry.attempted(call, self.endpoint.attempts, self.endpoint.first_wait_s)
            return key, status, body, None
        except HttpError as error:
            return key, error.status, None, f"{error.kind}: {error}"
        except Exception as error:  # noqa: BLE001 - becomes a value
            return key, None, None, f"{type(error).__name__}: {error}"


class Keys(InputPartition):
    def __init__(self, keys: list[str], of: int):
        self.keys, self.of = keys, of


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        if "{key}" not in options.get("url", ""):
            raise ValueError("the option url needs a {key}")
        self.keys = list(dict.fromkeys(json.loads(options.get("keys", "[]"))))
        self.n = max(1, int(options.get("partitions", 4)))
        self.endpoint = Endpoint(options["url"], float(options.get("timeout", 10)), int(options.get("attempts", 3)), float(options.get("wait", 0.5)), float(options.get("persecond", 0)))

    def partitions(self) -> list[InputPartition]:
        parts = [self.keys[k :: self.n] for k in range(self.n)]
        return [Keys(p, self.n) for p in parts if p] or [Keys([], 1)]

    def read(self, partition: Keys) -> Iterator[tuple]:
        session = Session(self.endpoint, partition.of)
        for key in partition.keys:
            yield session.row(key)


class RestSource(DataSource):
    """Options: url, keys (a JSON list), partitions, timeout, attempts, wait, perSecond."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> RestReader:
        return RestReader(dict(self.options))


def fetched(keys: DataFrame, endpoint: Endpoint, column: str = "key", partitions: int = 8) -> DataFrame:
    """ROWS for the distinct values of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = Session(endpoint, partitions)
        for batch in batches:
            for key in batch.column(0):
                row = session.row(key.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["key", "status", "body", "error"])

    return keys.select(F.col(column).cast("string").alias("key")).distinct().repartition(partitions, "key").mapInArrow(run, ROWS)
