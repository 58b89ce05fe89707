"""The HTTP feed and the alert sink against a loopback server."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from corvane.operators import govern
from corvane.sources import remote


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        pages: list = []
        got: list = []

        def do_GET(self):  # noqa: N802
            if self.path == "/pages.json":
                body = {"pages": len(self.pages)}
            else:
                body = self.pages[int(self.path.split("/")[-1].split(".")[0])]
            self.reply(json.dumps(body).encode())

        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"]))
            self.got.append((self.headers["Idempotency-Key"], json.loads(body)))
            self.reply(b"{}")

        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    Handler.pages, Handler.got = [], []
    web = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield Handler, f"http://127.0.0.1:{web.server_port}"
    web.shutdown()


def page(*entries):
    return {"version": "1", "entries": list(entries)}


def test_a_feed_read_twice_adds_nothing(spark, server):
    handler, url = server
    remote.register(spark)
    handler.pages[:] = [page({"id": "a", "pattern": "x", "severity": "low", "tags": [" T ", ""]}, {"id": "b", "pattern": "y", "name": " B "}), page({"id": "a", "pattern": "z"}, {"pattern": "no id"}, {"id": "none"}), page()]
    feed = spark.read.format("threat_feed").option("url", url + "/{page}.json").option("pages", 3).load()
    rows = feed.orderBy("page", "place").collect()
    assert [(r.id, r.name, r.pattern, r.category, r.severity, r.scope, r.source, r.tags, r.enabled, r.page) for r in rows] == [
        ("a", "a", "x", "INJECTION", "LOW", "both", "remote-feed", ["t"], True, 0), ("b", "B", "y", "INJECTION", "HIGH", "both", "remote-feed", [], True, 0), ("a", "a", "z", "INJECTION", "HIGH", "both", "remote-feed", [], True, 1),
    ]
    table = spark.createDataFrame([], "id string, pattern string, enabled boolean")
    new = feed.select("id", "pattern", "enabled", F.struct("page", "place").alias("seq"))
    once = govern.upsert(table, new, order="seq")
    twice = govern.upsert(once.drop("change"), new, order="seq")
    assert sorted(tuple(r) for r in once.collect()) == [("a", "z", True, "added"), ("b", "y", True, "added")]
    assert sorted(tuple(r) for r in twice.collect()) == [("a", "z", True, "updated"), ("b", "y", True, "updated")]


def test_a_bad_feed_is_refused(spark, server):
    handler, url = server
    remote.register(spark)
    for bad in ({"entries": {}}, page({"id": "a", "pattern": "("})):
        handler.pages[:] = [bad]
        with pytest.raises(Exception, match="list of entries|parenthesis|unterminated"):
            spark.read.format("threat_feed").option("url", url + "/{page}.json").load().collect()


def test_the_stream_reads_each_page_once(spark, server, tmp_path):
    handler, url = server
    remote.register(spark)
    handler.pages[:] = [page({"id": "a", "pattern": "x"})]

    def run():
        feed = spark.readStream.format("threat_feed").option("url", url + "/{page}.json").option("index", url + "/pages.json").load()
        q = feed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        return sorted((r.id, r.page) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a", 0)] and run() == [("a", 0)]
    handler.pages.append(page({"id": "a", "pattern": "y"}, {"id": "b", "pattern": "z"}))
    assert run() == [("a", 0), ("a", 1), ("b", 1)]


def test_alerts_are_written_once_for_each_committed_batch(spark, tmp_path):
    remote.register(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "alerts")
    decisions = spark.createDataFrame([(1, "HIGH", "é"), (2, "LOW", "b"), (3, "CRITICAL", None)], "id int, severity string, reason string")
    for _ in range(2):
        decisions.coalesce(1).write.mode("append").parquet(source)
        alerts = govern.alerts(spark.readStream.schema(decisions.schema).parquet(source))
        q = alerts.writeStream.format("alert_outbox").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
    read = lambda: sorted((r.id, r.severity, r.reason) for r in spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).schema("id int, severity string, reason string").json(f"{out}/batch-*").collect())
    assert read() == [(1, "HIGH", "é"), (1, "HIGH", "é"), (3, "CRITICAL", None), (3, "CRITICAL", None)]
    writer = remote.OutboxStream({"path": out})
    again = writer.write(iter(decisions.collect()))
    writer.commit([again, None], 1)  # a batch that comes again
    assert len(read()) == 4
    writer.abort([writer.write(iter(decisions.collect()))], 2)
    assert len(read()) == 4 and not list((tmp_path / "alerts/.staged").iterdir())
    govern.alerts(decisions).write.format("alert_outbox").option("batch", "x").mode("append").save(out)
    assert len(read()) == 6


def test_delivery_has_a_key_for_each_alert(spark, server):
    handler, url = server
    d = spark.createDataFrame([(k, "BLOCK", "HIGH", f"reason {k}") for k in range(6)], "id int, action string, severity string, reason string").repartition(3)
    d = d.withColumn("key", remote.alert_key(F.col("id"), F.col("action")))
    for _ in range(2):
        remote.deliver(d, url, "key", "id", "action", "severity", "reason")
    assert len(handler.got) == 12 and len({k for k, _ in handler.got}) == 6
    assert sorted(b["id"] for b in {k: b for k, b in handler.got}.values()) == list(range(6))
    remote.deliver(d.limit(1), url, "key", brief=True)
    assert handler.got[-1][1]["text"].startswith("Screening: BLOCK HIGH: reason")
