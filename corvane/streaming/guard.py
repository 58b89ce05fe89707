"""Screening of token streams and live sessions with Structured Streaming state.

A stream's text is checked whole whenever ``CHECK_EVERY`` characters wait: the cheap
detectors and the policy decide whether what waits goes out or the stream stops. At
its end what still waits goes out, and the full pipeline looks at the whole text.

Detectors are expressions and run in the JVM. So live screening is two stateful
steps with the detectors between them: ``Checkpoints`` turns tokens into texts to
check, ``Emitter`` turns verdicts into what is sent. ``screened`` is the same over
finished streams, and ``fold`` says it in plain Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.functions import constants as C
from corvane.functions.dialect import held, let
from corvane.operators import decide, detect

CHECK_EVERY = 150

#: What is sent in place of text, before the reason.
STOPPED = "\n\n[STREAM STOPPED BY POLICY] Reason: "
AFTERWARDS = "\n\n[FOUND UNSAFE AFTERWARDS] The text above does not pass a scan of the whole: "
FAILED = "\n\n[STREAM FAILED] Nothing more comes: "
#: Milliseconds without a token after which a stream counts as ended.
IDLE_MS = 600_000

POINTS = "stream_id string, n int, seq long, buffer string, text string, last boolean, error string"
OUTPUT = "stream_id string, seq long, emitted string, stopped boolean"
STOPPING = ("BLOCK", "REDACT")


def fold(tokens: list[str], unsafe: Callable[[str], str | None], finally_unsafe: Callable[[str], str | None] = lambda _: None, every: int = CHECK_EVERY) -> list[tuple[str, bool]]:
    """What a stream emits; both functions give a reason to stop or null."""
    out, total, waiting = [], "", ""
    for token in tokens:
        total, waiting = total + token, waiting + token
        if len(waiting) >= every:
            if (why := unsafe(total)) is not None:
                return [*out, (STOPPED + why, True)]
            out.append((waiting, False))
            waiting = ""
    out += [(waiting, False)] if waiting else []
    return [*out, (AFTERWARDS + why, True)] if (why := finally_unsafe(total)) is not None else out


class Checkpoints(StatefulProcessor):
    """State of a stream: the text so far, what waits, how many checks there were, the last token's place.

    A stream ends with a token that says ``last``, with an ``error`` of its source, after which
    what waits isn't sent, or by a timer when no token came for ``idle_ms``: then what waits goes
    out and the whole is looked at, as at any end. Tokens that come later begin anew.
    """

    def __init__(self, every: int = CHECK_EVERY, idle_ms: int = IDLE_MS):
        self.every, self.idle_ms = every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("text", "total string, waiting string, n int, seq long")

    def _points(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=["stream_id", "n", "seq", "buffer", "text", "last", "error"])

    def _timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        total, waiting, n, _ = self.state.get() if self.state.exists() else ("", "", 0, 0)
        out, ended, seq = [], True, 0
        for token in pd.concat(list(rows)).sort_values("seq").itertuples():
            text, seq, ended = token.token or "", token.seq, bool(token.last)
            error = getattr(token, "error", None)
            if isinstance(error, str):
                out.append((n, seq, "", total, True, error))
                ended = True
            else:
                total, waiting = total + text, waiting + text
                if len(waiting) >= self.every:
                    out.append((n, seq, waiting, total, False, None))
                    waiting, n = "", n + 1
                if ended:
                    out.append((n, seq, waiting, total, True, None))
            if ended:
                total, waiting, n = "", "", 0
        self._timers()
        if ended:
            self.state.clear()
        else:
            self.state.update((total, waiting, n, seq))
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._points(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.state.exists():
            total, waiting, n, seq = self.state.get()
            out.append((n, seq, waiting, total, True, None))
            self.state.clear()
        yield self._points(key, out)

    def close(self) -> None:
        pass


class Emitter(StatefulProcessor):
    """State of a stream: whether it was stopped."""

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stopped", "stopped boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        stopped = self.state.get()[0] if self.state.exists() else False
        out = []
        for r in pd.concat(list(rows)).sort_values(["seq", "n", "last"]).itertuples():
            bad = r.action in STOPPING
            if isinstance(r.error, str):
                if not stopped:
                    out.append((key[0], r.seq, FAILED + r.error, True))
            elif not stopped and not r.last:
                stopped = bad
                out.append((key[0], r.seq, STOPPED + r.reason if bad else r.buffer, bad))
            elif not stopped:
                if r.buffer:
                    out.append((key[0], r.seq, r.buffer, False))
                if bad:
                    out.append((key[0], r.seq, AFTERWARDS + r.reason, True))
            if r.last:
                stopped = False
                self.state.clear()
        if stopped:
            self.state.update((stopped,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "emitted", "stopped"])

    def close(self) -> None:
        pass


def _verdicts(points: DataFrame, settings: decide.Settings) -> DataFrame:
    """``action`` and ``reason`` of each text: cheap detectors and policy alone, the full pipeline for the last one."""
    d = decide.screen_cheap(points.withColumn("scan_target", F.lit("output")), settings)
    d = decide.screen_models(d.withColumn("gate_open", F.col("gate_open") & F.col("last")), settings)
    d = decide.decide(d, settings)
    return d.withColumns({"action": F.when(F.col("last"), F.col("action")).otherwise(F.col("policy_action")), "reason": F.when(F.col("last"), F.col("reason")).otherwise(F.col("policy_reason"))})


def guard(tokens: DataFrame, settings: decide.Settings = decide.Settings(), every: int = CHECK_EVERY, idle_ms: int = IDLE_MS) -> DataFrame:
    """Guards a stream of ``stream_id, seq, token, last`` (``last`` ends its stream) and perhaps ``error``,
    what its source failed with. A stream without a token for ``idle_ms`` is ended: what waits goes out."""
    points = tokens.groupBy("stream_id").transformWithStateInPandas(Checkpoints(every, idle_ms), POINTS, "Append", "ProcessingTime")
    verdicts = _verdicts(points, settings).select("stream_id", "n", "seq", "buffer", "last", "action", "reason", "error")
    return verdicts.groupBy("stream_id").transformWithStateInPandas(Emitter(), OUTPUT, "Append", "ProcessingTime")


def checkpoints(tokens: DataFrame, every: int = CHECK_EVERY) -> DataFrame:
    """``stream_id, total, cuts`` of finished streams: the whole text, put together once, and where it is
    checked (place after the text to check, and the token's ``seq``). One fold over token lengths."""
    d = tokens.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("token", F.lit("")).alias("token")))).alias("t"))
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("waiting"), F.array().cast("array<struct<pos:int,seq:bigint>>").alias("cuts"))

    def step(a: Column, x: Column) -> Column:
        pos, waiting = a["pos"] + x["n"], a["waiting"] + x["n"]
        due = waiting >= every
        cut = F.array(F.struct(pos.alias("pos"), x["seq"].cast("long").alias("seq")))
        return F.struct(pos.alias("pos"), F.when(due, 0).otherwise(waiting).alias("waiting"), F.when(due, F.concat(a["cuts"], cut)).otherwise(a["cuts"]).alias("cuts"))

    sizes = F.transform("t", lambda x: F.struct(x["seq"].alias("seq"), F.length(x["token"]).alias("n")))
    total = F.array_join(F.transform("t", lambda x: x["token"]), "")
    return d.select("stream_id", total.alias("total"), F.aggregate(sizes, start, step, lambda a: a["cuts"]).alias("cuts"))


def _stopped(points: DataFrame, first: Column) -> DataFrame:
    """``stream_id, checks, stopped_at, emitted_chars`` where ``first`` is the number of the first bad check, or null."""
    cut = lambda k, part: F.get("cuts", k)[part]
    before = F.when(first > 0, cut(first - 1, "pos")).otherwise(0)
    return points.select(
        "stream_id",
        F.coalesce(first + 1, F.size("cuts")).cast("int").alias("checks"),
        cut(first, "seq").alias("stopped_at"),
        F.when(first.isNull(), F.length("total")).otherwise(before).cast("long").alias("emitted_chars"),
    )


def guard_batch(tokens: DataFrame, pattern: str, every: int = CHECK_EVERY) -> DataFrame:
    """Where finished streams are checked and where they stop; ``pattern`` is a Java pattern that stops a stream."""
    points = checkpoints(tokens, every)
    hits = let(F.col("total"), lambda t: F.transform("cuts", lambda c: F.substring(t, F.lit(1), c["pos"]).rlike(pattern)))
    at = F.array_position(hits, F.lit(True)).cast("int")
    points = points.withColumn("_first", F.when(at > 0, at - 1))
    return _stopped(points, F.col("_first"))


def _stops(settings: decide.Settings, kind: str, rank: int) -> bool:
    """Whether the policy of streams stops at a threat of a type and severity."""
    severity = C.SEVERITIES[rank]
    own = settings.presets["balanced"].overrides.get(kind, {}) if "balanced" in settings.presets else {}
    return own.get(severity, C.POLICY[kind][4 - rank]) in STOPPING


def _few_checks(settings: decide.Settings) -> bool:
    """Whether it is known beforehand which checks can stop a stream: no rules, plug-ins or allowlist of the user's,
    flooding stops, and what ``detect.may_find`` leaves out doesn't."""
    plain = not settings.rules and not settings.plugins and "balanced" in settings.presets and not settings.presets["balanced"].allow
    return plain and _stops(settings, "DOS", 4) and not _stops(settings, "ABUSE", 2) and not _stops(settings, "SECRET", 1)


def _due(points: DataFrame, settings: decide.Settings) -> DataFrame:
    """Adds ``due``, number and place of the checks that can be the first bad one.

    A text beyond the flooding limit is stopped, so no check after the first such one counts;
    and where the text up to there holds nothing that a detector needs, no other check does.
    """
    cuts = F.transform("cuts", lambda c, i: F.struct(i.alias("n"), c["pos"].alias("pos")))
    if not _few_checks(settings):
        return points.withColumn("due", cuts)
    kept = F.filter(cuts, lambda c: (c["n"] == 0) | (F.get("cuts", c["n"] - 1)["pos"] <= settings.flooding_limit))
    d = points.withColumn("_kept", kept)
    tested = F.substring("total", F.lit(1), F.coalesce(F.element_at("_kept", -1)["pos"], F.lit(0)))
    d = detect.with_folded(d.withColumn("_tested", F.when(F.size("_kept") > 0, tested).otherwise("")), "_tested")
    d = d.withColumn("_may", held(detect.may_find("_tested", settings.signatures)))
    return d.withColumn("due", F.filter("_kept", lambda c: F.col("_may") | (c["pos"] > settings.flooding_limit))).drop("_kept", "_tested", "_tested_folded", "_may")


def screened(tokens: DataFrame, settings: decide.Settings = decide.Settings(), every: int = CHECK_EVERY) -> DataFrame:
    """The guard over finished streams, with detectors and policy: ``stream_id, checks, stopped_at, emitted_chars,
    reason`` (why it stopped) and ``retrospective`` (what the full pipeline says of a stream that went out).

    Only checks that can be the first bad one are made, each on all text up to it; with the default
    settings these are at most as many as fit into the flooding limit, however long a stream is."""
    points = checkpoints(tokens, every)
    last = F.array(F.struct(F.size("cuts").alias("n"), F.lit(None).cast("int").alias("pos")))
    each = _due(points, settings).select("stream_id", "total", F.explode(F.concat("due", last)).alias("_d")).select("stream_id", "total", "_d.*")
    each = each.select("stream_id", "n", F.col("pos").isNull().alias("last"), F.coalesce(F.substring("total", F.lit(1), F.col("pos")), "total").alias("text"))
    # no filter by verdict: it would be pushed below the detectors, with all of them in it
    stops = F.col("action").isin(*STOPPING)
    bad = _verdicts(each, settings).groupBy("stream_id").agg(F.min(F.when(stops & ~F.col("last"), F.struct("n", "reason"))).alias("_stop"), F.min(F.when(stops & F.col("last"), F.col("reason"))).alias("_after"))
    points = points.join(bad, "stream_id", "left")
    first = _stopped(points, F.col("_stop.n")).join(bad, "stream_id", "left")
    return first.select("stream_id", "checks", "stopped_at", "emitted_chars", F.col("_stop.reason").alias("reason"), F.when(F.col("stopped_at").isNull(), F.col("_after")).alias("retrospective"))


class SessionScore(StatefulProcessor):
    """Running score of a live session, with a time to live."""

    def __init__(self, ttl_ms: int = 86_400_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "score double, messages long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        score, n = self.score.get() if self.score.exists() else (0.0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("turn").itertuples():
            score, n = score + C.SESSION_POINTS.get(r.severity, 0.0), n + 1
            out.append((key[0], r.turn, score, n))
        self.score.update((score, n))
        yield pd.DataFrame(out, columns=["session_id", "turn", "session_score", "messages"])

    def close(self) -> None:
        pass


def live_scores(decisions: DataFrame) -> DataFrame:
    """Session scores of a stream of ``session_id, turn, severity``."""
    return decisions.groupBy("session_id").transformWithStateInPandas(SessionScore(), "session_id string, turn long, session_score double, messages long", "Append", "ProcessingTime")


def rate_limited(requests: DataFrame, limit: int, by: str = "user_id", at: str = "ts", late: str = "2 minutes") -> DataFrame:
    """Callers over the limit in a minute, over a stream with late rows dropped by a watermark."""
    d = requests.withWatermark(at, late) if requests.isStreaming else requests
    return d.groupBy(by, F.window(at, "1 minute")).agg(F.count(F.lit(1)).alias("requests")).filter(F.col("requests") > limit)
