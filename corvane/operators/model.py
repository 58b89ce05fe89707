"""Replies of model-backed scorers: read, filtered by confidence, merged with pattern matches.

A reply is the model's raw text. It is read tolerantly: code fences are taken off, and
if the rest is no JSON, the first balanced object in it is read. Anything else, and a
missing reply, gives no match. A scorer that doesn't answer in time makes its detector
unavailable, which ``decide`` treats as a finding (fail closed).
"""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.dialect import let, strip
from corvane.operators import detect

#: Characters of a text that a scorer is asked about.
ASKED = 3000
#: Seconds that a call may take, calls of a task at a time, and calls lost in a row after which a scorer is down.
DEADLINE, CALLS, GIVEN_UP = 8.0, 8, 32


@dataclass(frozen=True)
class Form:
    """Names in the replies of one scorer, and the match that stands for a bare verdict."""

    listed: str
    kind: str
    verdict: str
    bare_kind: str
    bare_said: str


#: Fixed values. The forms of replies.
FORMS = {
    "Injection Detector": Form("attacks_found", "injection_type", "is_injection", "PROMPT_INJECTION", "The scorer calls the text an attempt at prompt injection."),
    "Unsafe Content Detector": Form("content_found", "content_type", "is_unsafe", "UNSAFE_CONTENT", "The scorer calls the text unsafe."),
}

#: Fixed values. Categories that scorers are asked to choose from.
CATEGORIES = {
    "Injection Detector": (
        "PROMPT_INJECTION",
        "JAILBREAK",
        "ROLE_OVERRIDE",
        "SYSTEM_PROMPT_LEAK",
        "INDIRECT_INJECTION",
        "VIRTUALIZATION_ATTACK",
        "TOKEN_SMUGGLING",
        "MULTI_PROMPT_ATTACK",
        "CONTEXT_MANIPULATION",
        "INSTRUCTION_OVERRIDE",
        "ENCODING_OBFUSCATION",
    ),
    "Unsafe Content Detector": (
        "VIOLENCE",
        "SELF_HARM",
        "SEXUAL_EXPLICIT",
        "CSAM",
        "HATE_SPEECH",
        "EXTREMISM",
        "WEAPONS",
        "DRUG_MANUFACTURING",
        "BIOWEAPONS_CHEM",
        "CYBERCRIME",
        "HUMAN_TRAFFICKING",
        "ILLEGAL_ACTIVITY",
        "DANGEROUS_MISINFORMATION",
        "HARASSMENT",
        "PRIVACY_VIOLATION",
    ),
}


def prompt(detector: str, target: str = "input") -> str:
    """What a scorer is told; texts of documents are data and not requests, which it is told as well."""
    form = FORMS[detector]
    listed = ", ".join(CATEGORIES[detector])
    kind = "a document that a user uploads" if target == "document" else "a message"
    return (
        f"Classify {kind}. Categories: {listed}. Discussion, news, history and fiction without instructions for real harm are no finding. "
        f'Answer with one JSON object: {{"{form.verdict}": bool, "{form.listed}": [{{"{form.kind}": str, "description": str, "confidence": 0..1, "evidence": str}}]}}'
    )


def without_fences(raw: Column) -> Column:
    text = F.regexp_replace(strip(raw), r"(?U)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(text, r"(?U)\s*```$", ""))


def balanced(text: Column) -> Column:
    """The first balanced object of a text, braces in strings apart; null if there is none."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        c, inside = x["c"], a["quoted"]
        depth = a["depth"] + F.when(inside, 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        quoted = F.when(inside, a["escaped"] | (c != '"')).otherwise(c == '"')
        now = F.struct(depth.alias("depth"), quoted.alias("quoted"), (inside & ~a["escaped"] & (c == "\\")).alias("escaped"), F.when((c == "}") & ~inside & (depth == 0), x["i"]).otherwise(0).alias("end"))
        return F.when(a["end"] > 0, a).otherwise(now)

    def within(tail: Column) -> Column:
        chars = F.transform(F.split(tail, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))
        end = F.aggregate(chars, state, step, lambda a: a["end"])
        return let(end, lambda n: F.when(n > 0, F.substring(tail, F.lit(1), n)))

    return F.when(F.instr(text, "{") > 0, let(F.substring(text, F.instr(text, "{"), F.length(text)), within))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def reply_object(raw: Column) -> Column:
    """The reply as a variant object, null if it can't be read as one."""

    def read(text: Column) -> Column:
        whole = F.try_parse_json(text)
        part = F.try_parse_json(balanced(text))
        return F.when(whole.isNotNull(), F.when(_is_object(whole), whole)).when(_is_object(part), part)

    return let(without_fences(raw), read)


def threshold(override: Column, default: float = 0.5) -> Column:
    """The confidence that counts, cut to [0, 1]; it concerns the model's matches, never patterns."""
    return F.least(F.greatest(F.coalesce(override.cast("double"), F.lit(default)), F.lit(0.0)), F.lit(1.0))


def found(detector: str, raw: Column, least: Column) -> Column:
    """Matches that a scorer reports with confidence ``least`` or more; a bare verdict counts as one."""
    form, get = FORMS[detector], F.try_variant_get
    weight = lambda sure: F.when(sure >= 0.85, 4).otherwise(3)

    def read(o: Column) -> Column:
        items = F.filter(F.coalesce(get(o, f"$.{form.listed}", "array<variant>"), F.array().cast("array<variant>")), _is_object)
        said = lambda x, name, fall: F.coalesce(get(x, f"$.{name}", "string"), F.lit(fall))
        sure = lambda x: F.coalesce(get(x, "$.confidence", "double"), F.lit(0.5))
        listed = F.transform(F.filter(items, lambda x: sure(x) >= least), lambda x: detect.match(said(x, form.kind, "UNKNOWN"), said(x, "description", ""), F.substring(said(x, "evidence", ""), 1, 150), sure(x), weight(sure(x))))
        kind = F.lit(form.bare_kind) if detector == "Injection Detector" else said(o, form.kind, form.bare_kind)
        bare = F.when(F.coalesce(get(o, f"$.{form.verdict}", "boolean"), F.lit(False)) & (sure(o) >= least), F.array(detect.match(kind, form.bare_said, F.substring(said(o, "evidence", ""), 1, 150), sure(o), weight(sure(o)))))
        none = F.array().cast(f"array<{detect.MATCH}>")
        listed = listed.cast(f"array<{detect.MATCH}>")
        return F.coalesce(F.when(F.size(listed) > 0, listed).otherwise(bare.cast(f"array<{detect.MATCH}>")), none)

    return F.coalesce(let(reply_object(raw), read), F.array().cast(f"array<{detect.MATCH}>"))


def merged(by_model: Column, by_pattern: Column) -> Column:
    """The model's matches, then the patterns'; of one type the first stays."""

    def first(every: Column) -> Column:
        kinds = F.transform(every, lambda m: m["match_type"])
        return let(kinds, lambda k: F.filter(every, lambda m, i: F.array_position(k, m["match_type"]) == i + 1))

    return let(F.concat(by_model, by_pattern), first)


def answers(responder: Callable[[str, str], str], jobs: list[tuple[str, str]], deadline: float, calls: int) -> dict[tuple[str, str], tuple[str | None, str]]:
    """Reply and outcome (``ok``, ``failed`` or ``timeout``) of each job, a prompt and a text; at most ``calls`` run at a time.

    A call that isn't back after ``deadline`` seconds is left alone: its reply isn't waited
    for. After ``GIVEN_UP`` such calls in a row the scorer counts as down, and the jobs not
    yet begun are timeouts without being begun, so that a task ends.
    """
    done: queue.SimpleQueue = queue.SimpleQueue()

    def work(job: tuple[str, str]) -> None:
        try:
            done.put((job, responder(*job), "ok"))
        except Exception:  # whatever a scorer raises is its outcome
            done.put((job, None, "failed"))

    out, running, lost, todo = {}, {}, 0, deque(jobs)
    while todo or running:
        while todo and len(running) < calls:
            job = todo.popleft()
            if lost >= GIVEN_UP:
                out[job] = None, "timeout"
                continue
            running[job] = time.monotonic() + deadline
            threading.Thread(target=work, args=(job,), daemon=True).start()
        if running:
            try:
                job, reply, outcome = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
                if running.pop(job, None) is not None:
                    out[job], lost = (reply, outcome), 0
            except queue.Empty:
                for job in [j for j, end in running.items() if end <= time.monotonic()]:
                    del running[job]
                    out[job], lost = (None, "timeout"), lost + 1
    return out


def ask(texts: DataFrame, detector: str, responder: Callable[[str, str], str], column: str, deadline: float = DEADLINE, calls: int = CALLS, errors_close: bool = False) -> DataFrame:
    """Adds the replies of ``responder(prompt, text)`` to the first ``ASKED`` characters where the gate
    is open (column ``gate_open``); other rows never reach it.

    Equal texts of a batch are asked about once. A call that fails gives no reply. A detector
    whose call took longer than ``deadline`` seconds, with ``errors_close`` also one whose call
    failed, is added to the row's ``unavailable``, from which the decision fails closed.
    """
    told = {t: prompt(detector, t) for t in ("input", "document")}

    @F.pandas_udf(T.StructType([T.StructField("reply", T.StringType()), T.StructField("outcome", T.StringType())]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, target in batches:
            jobs = [None if x is None else (told["document" if where == "document" else "input"], x) for x, where in zip(text, target, strict=True)]
            got = answers(responder, list(dict.fromkeys(j for j in jobs if j is not None)), deadline, calls)
            yield pd.DataFrame([got.get(j, (None, None)) for j in jobs], columns=["reply", "outcome"], dtype=object)

    gone = F.coalesce("unavailable", F.array().cast("array<string>")) if "unavailable" in texts.columns else F.array().cast("array<string>")
    d = texts.withColumn(column, run(F.when(F.col("gate_open"), F.substring("text", 1, ASKED)), F.col("scan_target")))
    bad = F.coalesce(F.col(f"`{column}`.outcome").isin("timeout", *(["failed"] if errors_close else [])), F.lit(False))
    d = d.withColumn("unavailable", F.when(bad, F.array_union(gone, F.array(F.lit(detector)))).otherwise(gone))
    return d.withColumn(column, F.col(f"`{column}`.reply"))
