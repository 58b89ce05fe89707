"""Prompt and output as one interaction: pairing, contradiction and drift alerts, combined decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions.dialect import found
from corvane.operators import decide

ALERT = "struct<alert_type:string,severity:string,evidence:string>"


def pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it, by one window instead of a self-join."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns.filter(F.col("role").isin("user", "assistant"))
    d = d.withColumn("_next", F.lead(F.struct("role", "turn", "text")).over(w))
    d = d.filter((F.col("role") == "user") & (F.col("_next.role") == "assistant"))
    return d.select("conv_id", "turn", F.col("text").alias("prompt"), F.col("_next.turn").alias("output_turn"), F.col("_next.text").alias("output"))


def labels(agents: Column) -> Column:
    """Threat types and match types of the detectors that found something."""
    hit = F.filter(agents, lambda a: a["threat_found"])
    each = F.transform(hit, lambda a: F.concat(F.array(a["threat_type"]), F.when(a["threat_type"] == "DOS", F.array().cast("array<string>")).otherwise(F.transform(a["matched"], lambda m: F.upper(m["match_type"])))))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def _refuses(text: Column) -> Column:
    out = F.lit(False)
    for p in C.REFUSALS:
        out = out | found(text, p, "i")
    return F.coalesce(out, F.lit(False))


def contradictions(d: DataFrame) -> DataFrame:
    """Adds ``contradictions``. Needs p_ and o_ columns: action, severity (names), labels, text, reason."""
    rank, act = decide.severity_rank, decide.action_rank
    new = F.array_except("o_labels", "p_labels")
    stronger = act(F.col("o_action")) > act(F.col("p_action"))
    riskier = rank(F.col("o_severity")) > rank(F.col("p_severity"))
    alert = lambda kind, severity, said: F.struct(F.lit(kind).alias("alert_type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), said.alias("evidence"))
    every = F.array(
        F.when((F.size(new) > 0) & stronger, alert("output_policy_contradiction", F.when(rank(F.col("o_severity")) >= 3, "HIGH").otherwise("MEDIUM"), F.array_join(F.slice(new, 1, 5), ", "))),
        F.when(_refuses(F.col("p_text")) & ~_refuses(F.col("o_text")) & stronger, alert("refusal_break", "HIGH", F.substring("o_text", 1, 160))),
        F.when(
            riskier & F.col("o_action").isin("REDACT", "BLOCK") & (F.col("p_action") == "ALLOW"),
            alert("safe_prompt_unsafe_output", F.when(F.col("o_action") == "BLOCK", "CRITICAL").otherwise("HIGH"), F.substring("o_reason", 1, 200)),
        ),
    )
    return d.withColumn("contradictions", F.array_compact(every).cast(f"array<{ALERT}>"))


def drift(d: DataFrame, session: str = "session_id", turn: str = "turn", flag: float = 8.0, block: float = 12.0) -> DataFrame:
    """Adds ``drift``: risk against the session's earlier prompts. Needs p_severity and o_severity."""
    w = Window.partitionBy(session).orderBy(turn)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rank = decide.severity_rank(F.col("p_severity"))
    peak = F.greatest(rank, decide.severity_rank(F.col("o_severity")))
    points = F.coalesce(decide.lookup(C.SESSION_POINTS, F.col("p_severity")), F.lit(0.0))
    d = d.withColumns(
        {
            "_mean": F.avg(rank).over(before),
            "_risky": F.coalesce(F.sum(F.when(rank >= 2, 1).otherwise(0)).over(before), F.lit(0)),
            "session_risk_score": F.sum(points).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    alert = lambda kind, severity, said: F.struct(F.lit(kind).alias("alert_type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), said.alias("evidence"))
    every = F.array(
        F.when(peak >= F.col("_mean") + 2, alert("conversation_risk_spike", "HIGH", F.format_string("previous_avg=%.2f, current_peak=%d", F.col("_mean"), peak))),
        F.when((F.col("_risky") >= 2) & (decide.severity_rank(F.col("o_severity")) >= 3), alert("multi_turn_drift", "CRITICAL", F.format_string("risky_turns=%d", F.col("_risky")))),
        F.when(F.col("session_risk_score") >= flag, alert("elevated_session_risk", F.when(F.col("session_risk_score") >= block, "HIGH").otherwise("MEDIUM"), F.format_string("session_score=%.1f", F.col("session_risk_score")))),
    )
    return d.withColumn("drift", F.array_compact(every).cast(f"array<{ALERT}>")).drop("_mean", "_risky")


def alert_action(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 3).when(severity.isin("HIGH", "MEDIUM"), 1).otherwise(0)


def combine(d: DataFrame) -> DataFrame:
    """Adds ``combined_action``, ``combined_severity``, ``alert_types`` from both sides and all alerts."""
    alerts = F.concat("contradictions", F.coalesce("drift", F.array().cast(f"array<{ALERT}>")))
    d = d.withColumn("alerts", alerts)
    action = F.greatest(decide.action_rank(F.col("p_action")), decide.action_rank(F.col("o_action")), F.coalesce(F.array_max(F.transform("alerts", lambda a: alert_action(a["severity"]))), F.lit(0)))
    severity = F.greatest(decide.severity_rank(F.col("p_severity")), decide.severity_rank(F.col("o_severity")), F.coalesce(F.array_max(F.transform("alerts", lambda a: decide.severity_rank(a["severity"]))), F.lit(0)))
    return d.withColumns({"combined_action": decide.action_name(action), "combined_severity": decide.severity_name(severity), "alert_types": F.transform("alerts", lambda a: a["alert_type"])})


def analyze_interactions(turns: DataFrame, settings: decide.Settings = decide.Settings()) -> DataFrame:
    """Decisions of every prompt and output pair of ``conv_id, turn, role, text``, combined."""
    both = pairs(turns)
    sides = both.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit("input").alias("scan_target"), F.col("prompt").alias("text")), F.struct(F.lit("output").alias("scan_target"), F.col("output").alias("text")))).alias("x")).select("conv_id", "turn", "x.*")
    seen = decide.analyze(sides, settings).withColumn("labels", labels(F.col("agents")))
    one = F.struct("action", "severity", "labels", "text", "reason", "triggered_agents")
    pick = lambda target: F.max(F.when(F.col("scan_target") == target, one))
    d = seen.groupBy("conv_id", "turn").agg(pick("input").alias("p"), pick("output").alias("o"))
    cols = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "po" for c in ("action", "severity", "labels", "text", "reason", "triggered_agents")]
    d = contradictions(d.select("conv_id", "turn", *cols))
    d = combine(drift(d, "conv_id"))
    agents = F.array_distinct(F.concat(F.transform("p_triggered_agents", lambda a: F.concat(F.lit("prompt:"), a)), F.transform("o_triggered_agents", lambda a: F.concat(F.lit("output:"), a)), F.transform("alert_types", lambda a: F.concat(F.lit("interaction:"), a))))
    return d.withColumns({"triggered_agents": agents, "drift_detected": F.size("drift") > 0, "contradiction_detected": F.size("contradictions") > 0})
