"""Threat feeds over HTTP as a Spark source, and alerts as a Spark sink.

``register(spark)`` makes them known. The feed is read in pages, each by a task of its
own; as a stream its offsets are page numbers, so a page is read once for good, and a
replay reads the same pages:

    spark.read.format("threat_feed").option("url", "https://host/feed/{page}.json").option("pages", 40).load()
    spark.readStream.format("threat_feed").option("url", ...).option("index", "https://host/feed/pages.json").load()

The alert sink writes JSON lines into a folder that driver and executors share. Tasks
write files under ``.staged``; only when a micro-batch is committed do they take their
place, under the batch's number, and a batch that comes again replaces nothing. ``deliver``
posts alerts to a webhook from the tasks that hold them; each has a key of its own, by
which a receiver can drop what a repeated task sends twice.
"""

from __future__ import annotations

import json
import os
import re
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row

FEED_ROW = "id string, name string, pattern string, category string, severity string, scope string, description string, source string, tags array<string>, enabled boolean, page bigint, place bigint"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ThreatFeed)
    spark.dataSource.register(AlertOutbox)


def fetched(url: str, timeout: float) -> dict:
    with urllib.request.urlopen(urllib.request.Request(url, method="GET"), timeout=timeout) as response:
        return json.loads(response.read().decode("utf-8"))


def signatures(payload: dict, page: int) -> Iterator[tuple]:
    """The entries of a page with their defaults, in order; those without an id or pattern are passed over.

    A page without a list of entries, or with a pattern that doesn't compile, is refused as a whole.
    """
    entries = payload.get("entries", [])
    if not isinstance(entries, list):
        raise ValueError("a feed must have a list of entries")
    for place, e in enumerate(entries):
        if not e.get("id") or not e.get("pattern"):
            continue
        re.compile(e["pattern"])
        said = lambda name, fall, e=e: str(e.get(name, fall)).strip()
        tags = [t for t in (str(x).strip().lower() for x in e.get("tags", [])) if t]
        yield str(e["id"]), said("name", e["id"]), e["pattern"], said("category", "INJECTION").upper(), said("severity", "HIGH").upper(), said("scope", "both").lower(), said("description", ""), said("source", "remote-feed"), tags, bool(e.get("enabled", True)), page, place


@dataclass
class Page(InputPartition):
    number: int


class _Pages:
    """What both readers of the feed share; ``{page}`` in the address is the page's number."""

    def __init__(self, options) -> None:
        self.url, self.index, self.pages = options["url"], options.get("index", ""), int(options.get("pages", "1"))
        self.timeout = float(options.get("timeout", "8"))
        if not 1 <= self.timeout <= 30:
            raise ValueError("timeout must be from 1 to 30 seconds")

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from signatures(fetched(self.url.replace("{page}", str(partition.number)), self.timeout), partition.number)


class FeedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        pages = fetched(self.index, self.timeout)["pages"] if self.index else self.pages
        return [Page(k) for k in range(pages)]


class FeedStream(_Pages, DataSourceStreamReader):
    """Offsets are numbers of pages; ``index`` says how many there are by now."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"page": fetched(self.index, self.timeout)["pages"] if self.index else self.pages}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(k) for k in range(start["page"], end["page"])]

    def commit(self, end: dict) -> None:
        pass


class ThreatFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "threat_feed"

    def schema(self) -> str:
        return FEED_ROW

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FeedStream(self.options)


@dataclass
class Staged(WriterCommitMessage):
    path: str
    rows: int


class _Outbox:
    """Writes of one query: staged by the tasks, put in place at commit."""

    def __init__(self, options) -> None:
        self.folder = options["path"].removeprefix("file://")

    def write(self, rows: Iterator[Row]) -> Staged:
        os.makedirs(f"{self.folder}/.staged", exist_ok=True)
        n, path = 0, f"{self.folder}/.staged/{uuid.uuid4().hex}.jsonl"
        with open(path, "w", encoding="utf-8") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
                n += 1
        return Staged(path, n)

    def place(self, messages: list[Staged | None], batch: str) -> None:
        """Idempotent: a batch whose folder is there was committed before, what was staged again is dropped."""
        staged = [m for m in messages if m is not None]
        final, half = f"{self.folder}/batch-{batch}", f"{self.folder}/.half-{batch}-{uuid.uuid4().hex}"
        if not os.path.exists(final):
            os.makedirs(half)
            for k, m in enumerate(staged):
                if m.rows:
                    os.rename(m.path, f"{half}/part-{k:05d}.jsonl")
            os.rename(half, final)  # all of the batch or nothing
        self.drop(staged)

    def drop(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class OutboxWriter(_Outbox, DataSourceWriter):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.batch = options.get("batch", uuid.uuid4().hex)

    def commit(self, messages: list[Staged | None]) -> None:
        self.place(messages, self.batch)

    def abort(self, messages: list[Staged | None]) -> None:
        self.drop(messages)


class OutboxStream(_Outbox, DataSourceStreamWriter):
    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.place(messages, str(batchId))

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class AlertOutbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alert_outbox"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return OutboxWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return OutboxStream(self.options)


def alert_key(*columns: Column) -> Column:
    """A key by which an alert is known wherever it is sent from."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def deliver(alerts: DataFrame, url: str, key: str, *columns: str, brief: bool = False, timeout: float = 8) -> None:
    """Posts each row's columns as JSON, or with ``brief`` one line of text for a chat, with its key as ``Idempotency-Key``.

    A post that fails fails its task, which Spark runs again; rows that went out before go
    out again with the same key.
    """
    line = F.to_json(F.struct(F.concat(F.lit("Screening: "), "action", F.lit(" "), "severity", F.lit(": "), F.substring("reason", 1, 200)).alias("text")))
    body = line if brief else F.to_json(F.struct(*columns))

    def post(rows: Iterator[Row]) -> None:
        for row in rows:
            head = {"Content-Type": "application/json", "Idempotency-Key": row["key"]}
            with urllib.request.urlopen(urllib.request.Request(url, row["body"].encode(), head, method="POST"), timeout=timeout):
                pass

    alerts.select(F.col(key).alias("key"), body.alias("body")).foreachPartition(post)
