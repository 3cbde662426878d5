"""The REST source against a server on the loopback."""

import json
import threading
import time
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from veinstone.operators import metadata
from veinstone.sources import rest


@pytest.fixture
def server():
    seen, times = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            key = urllib.parse.unquote(self.path.removeprefix("/works/"))
            seen[key] += 1
            times.append(time.monotonic())
            status = {"none": 404, "closed": 403, "busy": 503, "later": 503 if seen[key] < 3 else 200, "limit": 429 if seen[key] < 2 else 200}.get(key, 200)
            if key == "slow":
                time.sleep(1.5)
            self.send_response(status)
            self.end_headers()
            if status == 200:
                self.wfile.write(json.dumps({"title": [f"Work {key}"], "DOI": f"10.1/{key}", "issued": {"date-parts": [[2020]]}}).encode())

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/works/{{key}}", seen, times
    httpd.shutdown()


def test_source(spark, server):
    url, seen, _ = server
    spark.dataSource.register(rest.RestSource)
    keys = ["a", "10.1/ü#? 1", "none", "closed", "busy", "later", "limit", "slow", "a", " "]
    rows = spark.read.format("rest").option("url", url).option("keys", json.dumps(keys)).option("partitions", "3").option("wait", "0.01").option("timeout", "0.5").load().collect()
    out = {r.key: r for r in rows}
    assert len(rows) == 9
    assert {k: (r.status, (r.error or "").split(":")[0]) for k, r in out.items()} == {"a": (200, ""), "10.1/ü#? 1": (200, ""), "none": (404, "NotFound"), "closed": (403, "Forbidden"), "busy": (503, "ServerError"), "later": (200, ""), "limit": (200, ""), "slow": (None, "TimeoutError"), " ": (None, "NoKey")}
    # 4xx are not tried again but for those that ask for it.
    assert (seen["none"], seen["closed"], seen["busy"], seen["later"], seen["limit"], seen["a"]) == (1, 1, 3, 3, 2, 1)
    assert json.loads(out["10.1/ü#? 1"].body)["title"] == ["Work 10.1/ü#? 1"]


def test_fetched_rows_go_on_as_metadata(spark, server):
    url, seen, times = server
    keys = spark.createDataFrame([(k,) for k in ["x", "y", None, "x", "none"]], "key string")
    made = rest.fetched(keys, rest.Endpoint(url, first_wait_s=0.01, per_second=20), partitions=2)
    out = {r.key: r for r in made.withColumn("work", metadata.crossref(F.col("body"))).collect()}
    assert out["x"].work.title == "Work x" and out["x"].work.year == 2020 and out[None].error == "NoKey" and out["none"].error.startswith("NotFound")
    assert seen["x"] == 1


def test_rate(server):
    url, _, times = server
    session = rest.Session(rest.Endpoint(url, per_second=20), 2)
    began = time.monotonic()
    for k in range(4):
        assert session.row(str(k))[1] == 200
    assert time.monotonic() - began >= 0.29


def test_wrong_options(spark):
    with pytest.raises(ValueError):
        rest.RestReader({"url": "http://x"})
    assert rest.Session(rest.Endpoint("file:///etc/{key}"), 1).row("x")[3].startswith("ValueError")
    assert len(rest.RestReader({"url": "http://x/{key}"}).partitions()) == 1
    assert rest.Session(rest.Endpoint("http://127.0.0.1:9/{key}", attempts=1), 1).row("x")[3].startswith("ConnectionError")
