"""Clusters against Lloyd's cost, and cursor pages from a local server."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import topics
from citeloom.plans.scratch import Tables
from citeloom.sources.cursor import CursorPages


def _cost(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, []).append(r.v)
    return sum(((np.array(g) - np.mean(g, axis=0)) ** 2).sum() for g in groups.values())


def test_transfers_never_cost_more_than_lloyd(spark):
    rng = np.random.default_rng(5)
    gained = 0
    for seed in range(3):
        x = rng.normal(size=(60, 3)) * rng.choice([1, 4], (60, 1))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, v array<double>")
        found = topics.kmeans(df, "v", 6, Tables(spark, "k"), seed=seed, iterations=3, restarts=1)
        rows = found.rows.collect()
        assert len(rows) == 60 and abs(_cost(rows) - found.cost) < 1e-6 and found.cost <= found.lloyd_cost + 1e-9
        gained += found.cost < found.lloyd_cost - 1e-9
        # no single move gains any more, or the rounds were used up
        top = topics.representatives(found, "v", "id", 2).collect()
        for r in top:
            own = [(float(((np.array(m.v) - found.centres[m.cluster]) ** 2).sum()), m.id) for m in rows if m.cluster == r.cluster]
            assert sorted(own)[r["rank"] - 1][1] == r.id
    assert gained


def test_clusters_are_no_more_than_different_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(10)], "id int, v array<double>")
    assert len({r.cluster for r in topics.kmeans(df, "v", 8, Tables(spark, "k")).rows.collect()}) == 2
    one = topics.kmeans(df.where("id % 2 = 0"), "v", 8, Tables(spark, "k"))
    assert one.issue == "too_few_distinct_vectors" and {r.cluster for r in one.rows.collect()} == {0}


def test_summaries_name_leading_terms(spark):
    from citeloom.functions.text import tfidf

    docs = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "delta alpha delta") for i in range(20)], "doc_id int, text string")
    out = {r.cluster: r for r in topics.summaries(tfidf(docs), docs.withColumn("cluster", F.col("doc_id") % 2), terms=2).collect()}
    assert out[0].top_terms == "delta | alpha" and out[1].n_docs == 10 and out[1].top_terms.split(" | ")[0] in ("beta", "gamma")


@pytest.fixture
def server(spark, sf_dir):
    """Payloads written from the pages table, served in pages of three; some answers fail at first."""
    urls = sorted(r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").limit(20).collect())
    asked, down = Counter(), {"on": False}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            key = (q["target"], q["cursor"])
            asked[key] += 1
            if down["on"]:
                return self._say(503, b"")
            if q["target"] == "gone":
                return self._say(404, b"")
            if q["target"] == "broken":
                return self._say(200, b"{no json")
            if q["cursor"] == "3" and asked[key] == 1:
                return self._say(429, b"")
            at = 0 if q["cursor"] == "*" else int(q["cursor"])
            items = [] if q["target"] == "none" else [{"url": u, "of": q["target"]} for u in urls[at : at + 3]]
            after = str(at + 3) if at + 3 < len(urls) and items else None
            self._say(200, json.dumps({"meta": {"next_cursor": after}, "results": items}).encode())

        def _say(self, code, body):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    spark.dataSource.register(CursorPages)
    yield f"http://127.0.0.1:{httpd.server_port}/works", urls, asked, down
    httpd.shutdown()


def _load(spark, url, targets, **options):
    reader = spark.read.format("cursor_pages").option("url", url).option("targets", json.dumps(targets)).option("pause", "0.01")
    return reader.options(**options).load().collect()


def test_pages_come_back_row_by_row(spark, server):
    url, urls, asked, _ = server
    rows = _load(spark, url, ["a", "gone", "broken", "none", " ", "kept"], cache=json.dumps({"kept": [{"results": [{"n": 1}]}, {"results": [{"n": 2}]}]}))
    by = {}
    for r in rows:
        by.setdefault(r.target, []).append(r)
    got = sorted(by["a"], key=lambda r: (r.page, r.item_index))
    assert [json.loads(r.item)["url"] for r in got] == urls and {r.status for r in got} == {"fetched"}
    assert asked["a", "3"] == 2 and all(n == 1 for (t, c), n in asked.items() if t == "a" and c != "3")
    assert [(r.status, r.item) for t in ("gone", "broken", "none", " ") for r in by[t]] == [("http_404", None), ("json_error", None), ("fetched", None), ("skipped_no_query", None)]
    assert asked["gone", "*"] == 1 and [json.loads(r.item) for r in sorted(by["kept"], key=lambda r: r.page)] == [{"n": 1}, {"n": 2}]
    assert max(r.page for r in _load(spark, url, ["b"], max_pages="2")) == 2
    assert [r.status for r in _load(spark, url, ["c"], enabled="false")] == ["skipped_api_disabled"] and ("c", "*") not in asked


def test_a_stream_goes_on_at_its_cursor(spark, server, tmp_path):
    url, urls, asked, down = server
    stream = lambda: spark.readStream.format("cursor_pages").option("url", url).option("targets", '["s"]').option("pause", "0.01").load()

    def run(seconds):
        q = stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").start()
        try:
            q.awaitTermination(seconds)
            if not down["on"]:
                q.processAllAvailable()
        finally:
            q.stop()

    down["on"] = True
    with pytest.raises(Exception, match="http_503"):
        run(60)
    down["on"] = False
    first = Counter(asked)
    run(1)
    run(1)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(json.loads(r.item)["url"] for r in rows) == urls
    again = asked - first
    assert sum(again.values()) <= 2 * len({k for k in again}) + 2
