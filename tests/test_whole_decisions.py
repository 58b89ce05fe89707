"""Registered queries of whole decisions against a plain Python engine, on whole tables."""

import hashlib
import os

from tests import plain_engine as plain
import pyarrow.parquet as pq
import pytest

from corvane.plans import probes, registry, screening

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def rows(spark, name, key):
    got = registry.QUERIES[name](spark, DATA).collect()
    out = {r[key] if isinstance(key, str) else tuple(r[k] for k in key): r for r in got}
    assert len(out) == len(got)
    return out


def sha(text):
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] for r in read("documents")}


def test_pii_matches_and_redaction(spark, documents):
    got, masked = rows(spark, "pii_matches", "doc_id"), rows(spark, "pii_redaction", "doc_id")
    assert got.keys() == masked.keys() == documents.keys()
    for i, text in documents.items():
        found = plain.pii(text or "")
        assert got[i].found == ",".join(x["type"] for x in found)
        assert got[i].evidence == ",".join(x["evidence"] for x in found)
        assert got[i].severity == plain.C.SEVERITIES[plain.pii_severity(found)]
        assert masked[i].redacted_sha256 == sha(plain.redacted(text or "", ["PII Detector"]))


def test_secret_redaction_and_abuse(spark, documents):
    masked, got = rows(spark, "secret_redaction", "doc_id"), rows(spark, "abuse_matches", "doc_id")
    for i, text in documents.items():
        assert masked[i].redacted_sha256 == sha(plain.redacted(text or "", ["Secrets Detector"]))
        found = plain.abuse(text or "")
        assert got[i].found == ",".join(x["type"] for x in found)
        assert got[i].evidence == "\n".join(x["evidence"] for x in found), i


def test_high_entropy_secrets(spark, documents):
    got = rows(spark, "secret_findings", "doc_id")
    for i, text in documents.items():
        found = plain.secrets(text or "")
        assert (got[i].found, got[i].evidence) == (",".join(x["type"] for x in found), "\n".join(x["evidence"] for x in found))


def test_decisions(spark, documents):
    got = rows(spark, "decisions", "doc_id")
    assert got.keys() == documents.keys()
    counts = {}
    for i, text in documents.items():
        want, r = plain.decide(text), got[i]
        assert (r.action, r.severity, r.risk_level, r.adversary_tier, r.reason, r.confidence_level) == tuple(want[k] for k in ("action", "severity", "risk_level", "tier", "reason", "level")), i
        assert (r.risk_score, r.ensemble_risk, r.gate_score) == pytest.approx((want["risk_score"], want["ensemble_risk"], want["gate_score"]), abs=1e-4)
        assert r.agents == ",".join(want["agents"]) and r.redacted_sha256 == sha(want["redacted"])
        key = (want["action"], want["severity"])
        counts.setdefault(key, []).append(want["risk_score"])
    summary = rows(spark, "decision_summary", ("action", "severity"))
    assert {k: r.n for k, r in summary.items()} == {k: len(v) for k, v in counts.items()}
    assert all(summary[k].mean_risk == pytest.approx(sum(v) / len(v), abs=1e-3) for k, v in counts.items())


def test_probe_decisions(spark):
    """Without rules of the user's, which the plain engine doesn't have."""
    from corvane.operators import decide

    d = decide.explain(decide.analyze(probes.probes(spark), decide.Settings(gate_enabled=False)))
    got = {r.probe_id: r for r in d.collect()}
    for probe_id, _, _, target, _, profile, _, _, text in probes.rows():
        want, r = plain.decide(text, profile, target, gate=False), got[probe_id]
        assert (r.action, r.severity, r.risk_level, r.adversary_tier, r.reason, r.redacted_text) == tuple(want[k] for k in ("action", "severity", "risk_level", "tier", "reason", "redacted")), probe_id
        assert r.risk_score == pytest.approx(want["risk_score"], abs=1e-4) and r.ensemble_risk == pytest.approx(want["ensemble_risk"], abs=1e-5)
        assert r.matched_threats == want["matched"] and [f.finding for f in r.top_findings] == want["findings"]


def test_session_decisions(spark):
    turns = {}
    for r in sorted(read("conversations"), key=lambda r: r["turn"]):
        if r["role"] == "user":
            turns.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    check_sessions(rows(spark, "session_decisions", ("session_id", "turn")), {s: (t, "balanced", True) for s, t in turns.items()})


def test_probe_sessions(spark):
    own = {}
    for r in probes.planted(spark, DATA).orderBy("turn").collect():
        own.setdefault(r.session_id, []).append((r.turn, r.text, r.policy_profile))
    got = {(r.session_id, r.turn): r for r in registry.QUERIES["probe_sessions"](spark, DATA).collect()}
    for s, t in own.items():
        for (turn, *_), want in zip(t, plain.session([x[1] for x in t], [x[2] for x in t], gate=False), strict=True):
            r = got[(s, turn)]
            assert (r.session_score, r.cross_turn_injection, r.session_action) == (want["session_score"], want["cross"], want["session_action"]), (s, turn)
            said = [x.split(":") for x in r.patterns.split(",") if x]
            assert [(k, pytest.approx(float(c), abs=1e-5)) for k, c in said] == want["patterns"]


def check_sessions(got, sessions):
    assert len(got) == sum(len(t) for t, *_ in sessions.values())
    for s, (t, profile, gate) in sessions.items():
        for (turn, _), want in zip(t, plain.session([x for _, x in t], profile, gate), strict=True):
            r = got[(s, turn)]
            assert (r.action, r.severity, r.session_score, r.cross_turn_injection, r.session_action) == (want["action"], want["severity"], want["session_score"], want["cross"], want["session_action"]), (s, turn)
            assert r.patterns == ",".join(p for p, _ in want["patterns"])


def test_interactions(spark):
    got, by = rows(spark, "interactions", ("conv_id", "turn")), {}
    for r in read("conversations"):
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    n = 0
    for conv, turns in by.items():
        for want in plain.interactions(turns):
            r, n = got[(conv, want["turn"])], n + 1
            assert (r.combined_action, r.combined_severity, r.agents, r.alerts, r.session_risk_score, r.contradiction_detected) == (
                want["action"], want["severity"], ",".join(want["agents"]), ",".join(want["alerts"]), want["score"], want["contradicted"],
            )
    assert n == len(got)


def test_stream_queries(spark):
    import re

    from corvane.streaming import guard

    got, live = rows(spark, "stream_guard", "stream_id"), rows(spark, "stream_interventions", "stream_id")
    streams = {f"{r['conv_id']}-{r['turn']}": r["text"] for r in read("conversations") if r["role"] == "assistant"}
    assert got.keys() == live.keys() == streams.keys()
    bad = ("BLOCK", "REDACT")

    def early(text):
        agents, _ = plain.screen(text)
        cheap = [a for a in agents if a["found"] and a["agent"] not in plain.C.MODEL_BACKED]
        act = max((plain.policy("balanced", a["type"], a["severity"]) for a in cheap), default=0)
        return " | ".join(f"{a['agent']}: {a['type']} [{plain.C.SEVERITIES[a['severity']]}]" for a in cheap) if act >= 2 else None

    def late(text):
        d = plain.decide(text, target="output")
        return d["reason"] if d["action"] in bad else None

    for s, text in streams.items():
        tokens = re.split("(?<= )", text)
        out = guard.fold(tokens, lambda t: "" if re.search(plain.C.GATE_WORDS, t, re.I) else None)
        assert (got[s].stopped_at is not None, got[s].emitted_chars) == (out[-1][1] if out else False, sum(len(t) for t, stop in out if not stop))
        out = guard.fold(tokens, early, late)
        said = [t for t, stop in out if stop]
        assert live[s].emitted_chars == sum(len(t) for t, stop in out if not stop)
        assert [guard.STOPPED + x for x in [live[s].reason] if x is not None] + [guard.AFTERWARDS + x for x in [live[s].retrospective] if x] == said
