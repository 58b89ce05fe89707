"""Sessions and caches that live in a stream.

Detectors and session rules are expressions, so a live session is two small stateful
steps between them: ``Recent`` keeps a session's score and its last texts, ``History``
a ring of its last messages' records. The rules that read them are those of
``operators.session``; the result is the same as that of ``session.judge`` over the
finished sessions, however their turns fall into micro-batches, as long as a session's
turns come in order. A session without a turn for ``ttl_ms`` is forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.functions import constants as C
from corvane.operators import cache, decide, session

TTL_MS = 86_400_000
LOOK_BACK = 3

TURN = "session_id string, turn long, text string, action string, severity string, policy_profile string, threat_types array<string>, triggered_agents array<string>"
RECENT = TURN + ", session_score double, _joined string, _prior boolean"
_KEPT = "session_id string, turn long, action string, severity string, policy_profile string, session_score double, cross_turn_injection boolean"
HISTORY = _KEPT + ", _h array<struct<" + ", ".join(f"{n}:{t}" for n, t in session.RECORD.items()) + ">>"


def _names(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split(", ") if " " in part]


class Recent(StatefulProcessor):
    """State of a session: its score, how many messages, the last texts."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "score double, messages long", self.ttl_ms)
        self.texts = handle.getListState("texts", "text string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        score, n = self.score.get() if self.score.exists() else (0.0, 0)
        texts = [t[0] for t in self.texts.get()] if self.texts.exists() else []
        own = pd.concat(list(rows)).sort_values("turn")
        scores, joined, prior = [], [], []
        for r in own.itertuples():
            score += C.SESSION_POINTS.get(r.severity, 0.0)
            texts = [*texts[-LOOK_BACK:], r.text or ""]
            scores.append(score)
            joined.append(" ".join(texts))
            prior.append(n > 0)
            n += 1
        self.score.update((score, n))
        self.texts.put([(t,) for t in texts[-LOOK_BACK:]])
        yield own.assign(session_id=key[0], session_score=scores, _joined=joined, _prior=prior)[_names(TURN) + ["session_score", "_joined", "_prior"]]

    def close(self) -> None:
        pass


class History(StatefulProcessor):
    """State of a session: the records of its last messages."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", ", ".join(f"{n} {t}" for n, t in session.RECORD.items()), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        plain = lambda v: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v
        ring = [tuple(map(plain, r)) for r in self.ring.get()] if self.ring.exists() else []
        own = pd.concat(list(rows)).sort_values("turn")
        histories = []
        for r in own.to_dict("records"):
            new = (int(r["s"]), bool(r["inj"]), bool(r["uns"]), list(r["cred"]), bool(r["role"]), list(r["agents"]))
            ring = [*ring, new][-session.HISTORY :]
            histories.append([dict(zip(session.RECORD, m, strict=True)) for m in ring])
        self.ring.put(ring)
        yield own.assign(session_id=key[0], _h=histories)[[*_names(_KEPT), "_h"]]

    def close(self) -> None:
        pass


def sessions(decisions: DataFrame, settings: decide.Settings = decide.Settings(), ttl_ms: int = TTL_MS) -> DataFrame:
    """Judges a stream of decided turns (``session_id, turn, text`` and what ``decide.analyze`` adds) as they come:
    ``session_id, turn, action, severity, session_score, cross_turn_injection, patterns, session_action``."""
    d = decisions.withColumn("threat_types", session.threat_types()).select(F.col("session_id").cast("string"), F.col("turn").cast("long"), *_names(TURN)[2:])
    d = d.groupBy("session_id").transformWithStateInPandas(Recent(ttl_ms), RECENT, "Append", "ProcessingTime")
    d = session.crossed(d)
    d = d.select(*_names(_KEPT), *[c.alias(n) for n, c in session.record().items()])
    d = d.groupBy("session_id").transformWithStateInPandas(History(ttl_ms), HISTORY, "Append", "ProcessingTime")
    return session.concluded(session.shown(d), settings).drop("policy_profile")


class Responses(StatefulProcessor):
    """A response cache with a time to live and a greatest size, first in first out, for each key of its own.

    Entries are kept by their place of insertion; a hit neither renews an entry nor moves it.
    Without a time to live nothing is kept.
    """

    def __init__(self, ttl: float = cache.TTL_SECONDS, most: int = 500):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "cache_key string", "since double, place long, answer string")
        self.placed = handle.getValueState("placed", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        before = set(held)
        n = self.placed.get()[0] if self.placed.exists() else 0
        own = pd.concat(list(rows)).sort_values(["at", "request_id"])
        out = []
        for r in own.itertuples():
            held = {k: v for k, v in held.items() if r.at - v[0] <= self.ttl} if self.ttl > 0 else {}
            entry = held.get(r.cache_key)
            if entry is None:
                # one that was dropped comes in last; only living ones keep their place
                held[r.cache_key] = entry = (r.at, n, r.answer)
                n += 1
                out.append((key[0], r.request_id, False, r.answer))
                while len(held) > self.most:
                    del held[min(held, key=lambda k: held[k][1])]
            else:
                out.append((key[0], r.request_id, True, entry[2]))
        for k in before - set(held):
            self.entries.removeKey((k,))
        for k, v in held.items():
            self.entries.updateValue((k,), v)
        self.placed.update((n,))
        yield pd.DataFrame(out, columns=["cache", "request_id", "hit", "answer"])

    def close(self) -> None:
        pass


def responses(requests: DataFrame, ttl: float = cache.TTL_SECONDS, most: int = 500) -> DataFrame:
    """Hits of a stream of ``cache, request_id, at, cache_key, answer``: ``cache, request_id, hit, answer``.

    ``cache`` names the cache that a request asks, such as its workspace; ``at`` is in seconds,
    and requests of a cache come in order. What is answered on a hit is what was stored.
    """
    d = requests.select("cache", "request_id", F.col("at").cast("double"), "cache_key", "answer")
    return d.groupBy("cache").transformWithStateInPandas(Responses(ttl, most), "cache string, request_id long, hit boolean, answer string", "Append", "ProcessingTime")


def learning(decided: Callable[[DataFrame, DataFrame], DataFrame], path: str, id_column: str = "vec_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that decides each micro-batch with the threats learned so far, and learns from it.

    ``decided(texts, threats)`` gives decisions of a batch, with its columns, in the light of
    the threat table; they are appended to ``<path>/decisions``, and what model-backed detectors
    found new in them to ``<path>/threats``. Each batch writes a folder of its own number, so a
    batch that is run again after a failure replaces what it wrote, and it sees the threats of
    lesser numbers only, as the first time.
    """
    columns = f"{id_column} bigint, embedding array<double>, threat_type string, severity string, source_agent string"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(columns + ", batch bigint").option("basePath", f"{path}/threats").option("pathGlobFilter", "*.parquet")
        threats = known.parquet(f"{path}/threats").filter(F.col("batch") < number).drop("batch") if _exists(spark, f"{path}/threats") else spark.createDataFrame([], columns)
        out = f"{path}/decisions/batch={number}"
        decided(batch, threats).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out)
        new = cache.learned(done.filter(F.col("cached_threat").isNull()), id_column, "embedding")
        new = new.filter(F.col("embedding").isNotNull()).select(F.col(id_column).cast("bigint"), F.col("embedding").cast("array<double>"), "threat_type", "severity", "source_agent")
        new.write.mode("overwrite").parquet(f"{path}/threats/batch={number}")

    return run


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
