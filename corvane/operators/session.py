"""Multi-turn rules as windows over a session's turns.

``turns`` holds one row per input message: ``session_id, turn, text``, and what
``decide.analyze`` adds. Nothing here feeds back, so one shuffle by session and one
sort serve all rules. A session's history is its last ``HISTORY`` messages; the
window carries only the narrow fields that the rules read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions.dialect import double_sum, found
from corvane.operators import decide, detect

HISTORY = 50


def ordered(session: str = "session_id", turn: str = "turn"):
    return Window.partitionBy(session).orderBy(turn)


def with_scores(turns: DataFrame) -> DataFrame:
    """Adds ``session_score``, the sum of severity points up to and with the turn."""
    points = F.coalesce(decide.lookup(C.SESSION_POINTS, F.col("severity")), F.lit(0.0))
    return turns.withColumn("session_score", F.sum(points).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


def threshold_action(score: Column, action: Column, flag: Column, block: Column) -> Column:
    """BLOCK at the block threshold; FLAG at the flag threshold if the action is weaker."""
    return F.when(score >= block, 3).when((score >= flag) & (action < 1), 1).otherwise(action)


def recent_text(n: int = 3) -> Column:
    """The last ``n`` texts and the current one, joined by a space."""
    return F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(ordered().rowsBetween(-n, 0)), " ")


def _history(fields: Column) -> Column:
    return F.collect_list(fields).over(ordered().rowsBetween(-(HISTORY - 1), 0))


def _rises(ranks: Column) -> Column:
    """How often a rank is above the one before; before the first is 0."""
    return F.size(F.filter(ranks, lambda r, i: r > F.coalesce(F.get(ranks, i - 1), F.lit(0))))


def _mean(x: Column) -> Column:
    return double_sum(F.transform(x, lambda v: v.cast("double"))) / F.size(x)


#: What a history keeps of each message.
RECORD = {"s": "int", "inj": "boolean", "uns": "boolean", "cred": "array<string>", "role": "boolean", "agents": "array<string>"}


def record() -> dict[str, Column]:
    """``RECORD`` of a turn, from its text, ``severity``, ``threat_types`` and ``triggered_agents``."""
    kinds = F.array_compact(F.array(*[F.when(found(F.col("text"), p, "i"), F.lit(k)) for k, p in C.CREDENTIAL_REQUESTS.items()]))
    override = found(F.col("text"), C.ROLE_WORDS, "i") & found(F.col("text"), C.NO_RULES_WORDS, "i")
    return {
        "s": decide.severity_rank(F.col("severity")),
        "inj": F.array_contains("threat_types", "INJECTION"),
        "uns": F.array_contains("threat_types", "UNSAFE_CONTENT"),
        "cred": F.coalesce(kinds, F.array().cast("array<string>")),
        "role": F.coalesce(override, F.lit(False)),
        "agents": F.col("triggered_agents"),
    }


def patterns(turns: DataFrame) -> DataFrame:
    """Adds ``patterns``: the attack patterns that the history up to the turn shows.

    Needs ``severity``, ``threat_types`` and ``triggered_agents`` of each turn.
    """
    return shown(turns.withColumn("_h", _history(F.struct(*[c.alias(n) for n, c in record().items()]))))


def shown(d: DataFrame) -> DataFrame:
    """Adds ``patterns`` in place of a column ``_h``, the records of the history up to the turn."""
    ranks = lambda keep: F.transform(F.filter("_h", keep), lambda m: m["s"])
    d = d.withColumns(
        {
            "_n": F.size("_h"),
            "_inj": ranks(lambda m: m["inj"]),
            "_uns": ranks(lambda m: m["uns"]),
            "_cred": F.size(F.array_distinct(F.flatten(F.transform("_h", lambda m: m["cred"])))),
            "_role": F.size(F.filter("_h", lambda m: m["role"])),
            "_all": F.transform("_h", lambda m: m["s"]),
        }
    )
    half = F.floor(F.col("_n") / 2).cast("int")
    agents = lambda part: F.array_distinct(F.flatten(F.transform(part, lambda m: m["agents"])))
    d = d.withColumns(
        {
            "_rises": _rises(F.col("_inj")),
            "_recent": _mean(F.when(F.col("_n") >= 5, F.slice("_all", -5, 5)).otherwise(F.col("_all"))),
            "_early": _mean(F.slice("_all", 1, 3)),
            "_before": agents(F.slice("_h", F.lit(1), half)),
            "_after": agents(F.slice("_h", half + 1, F.greatest(F.col("_n") - half, F.lit(0)))),
        }
    )
    steady = F.forall(F.sequence(F.lit(0), F.greatest(F.size("_uns") - 2, F.lit(0))), lambda i: F.coalesce(F.get("_uns", i) <= F.get("_uns", i + 1), F.lit(True)))
    ratio = F.col("_recent") / F.greatest(F.col("_early"), F.lit(0.1))
    say = lambda kind, severity, sure, n: F.struct(F.lit(kind).alias("type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.round(sure, 6).alias("confidence"), n.cast("int").alias("occurrences"))
    one = F.lit(1.0)
    found_ = F.array(
        F.when((F.size("_inj") >= 2) & (F.col("_rises") >= 2), say("escalating_injection", "HIGH", F.least(F.col("_rises") / F.size("_inj"), one), F.size("_inj"))),
        F.when(F.col("_cred") >= 2, say("credential_probing", "HIGH", F.least(F.col("_cred") / 4, one), F.col("_cred"))),
        F.when(F.col("_role") >= 2, say("role_override_chain", "CRITICAL", F.least(F.col("_role") / F.col("_n"), one), F.col("_role"))),
        F.when((F.size("_uns") >= 2) & steady, say("phased_unsafe_content", "HIGH", F.when(F.size("_uns") >= 3, 0.8).otherwise(0.6), F.size("_uns"))),
        F.when((F.col("_n") >= 3) & (ratio > 1.5), say("severity_escalation", F.when(F.col("_recent") >= 2, "HIGH").otherwise("MEDIUM"), F.least((ratio - 1) / 3, one), F.col("_n"))),
        F.when(
            (F.col("_n") >= 4) & (F.size(F.array_except("_after", "_before")) >= 2) & (F.size(F.array_except("_before", "_after")) >= 1), say("detector_evasion", "MEDIUM", F.lit(0.7), F.col("_n"))
        ),
    )
    return d.withColumn("patterns", F.array_compact(found_)).drop("_h", "_n", "_inj", "_uns", "_cred", "_role", "_all", "_rises", "_recent", "_early", "_before", "_after")


#: Fixed values. What a pattern of confidence 0.7 or more does; a type not named does nothing.
PATTERN_ACTIONS = {"credential_probing": 3, "detector_evasion": 3, "role_override_chain": 3, "phased_unsafe_content": 1, "severity_escalation": 1}


def pattern_action(found_patterns: Column) -> Column:
    rank = F.transform(found_patterns, lambda p: F.when(p["confidence"] >= 0.7, F.coalesce(decide.lookup(PATTERN_ACTIONS, p["type"]), F.lit(0))).otherwise(0))
    return F.coalesce(F.array_max(rank), F.lit(0))


def crossed(d: DataFrame) -> DataFrame:
    """Adds ``cross_turn_injection`` in place of ``_joined``, the last four texts as one, and ``_prior``, whether
    there was a turn before; a hit is one more triggered agent."""
    d = detect.with_folded(d.withColumn("_norm", detect.normalised(F.col("_joined"))), "_norm")
    d = d.withColumn("cross_turn_injection", F.col("_prior") & ~F.array_contains("threat_types", "INJECTION") & (F.size(detect.injection("_norm")) > 0))
    agents = F.when(F.col("cross_turn_injection"), F.concat("triggered_agents", F.array(F.lit("Multi-turn Injection Detector")))).otherwise(F.col("triggered_agents"))
    return d.withColumn("triggered_agents", agents).drop("_joined", "_prior", "_norm", "_norm_folded")


def concluded(d: DataFrame, settings: decide.Settings) -> DataFrame:
    """Adds ``session_action``: of what score, cross-turn check and patterns ask for, the most severe."""
    flag = F.coalesce(decide.lookup({k: p.flag for k, p in settings.presets.items()}, F.col("policy_profile")), F.lit(8.0))
    block = F.coalesce(decide.lookup({k: p.block for k, p in settings.presets.items()}, F.col("policy_profile")), F.lit(12.0))
    scored = threshold_action(F.col("session_score"), decide.action_rank(F.col("action")), flag, block)
    total = F.greatest(scored, F.when(F.col("cross_turn_injection"), 3).otherwise(0), pattern_action(F.col("patterns")))
    return d.withColumn("session_action", decide.action_name(total))


def threat_types() -> Column:
    return F.transform(F.filter("agents", lambda a: a["threat_found"]), lambda a: a["threat_type"])


def judge(turns: DataFrame, settings: decide.Settings = decide.Settings()) -> DataFrame:
    """The decision of each turn in the light of its session.

    Adds ``session_score``, ``cross_turn_injection``, ``patterns`` and ``session_action``.
    The cross-turn check reads the last four texts as one and bypasses the gate.
    """
    d = with_scores(turns).withColumn("threat_types", threat_types())
    d = d.withColumn("_joined", recent_text()).withColumn("_prior", F.row_number().over(ordered()) > 1)
    return concluded(patterns(crossed(d)), settings)


def summaries(judged: DataFrame) -> DataFrame:
    """One row per session: messages, messages with a threat, score, flags."""
    points = F.coalesce(decide.lookup(C.SESSION_POINTS, F.col("severity")), F.lit(0.0))
    return judged.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.sum(F.when(F.size("threat_types") > 0, 1).otherwise(0)).alias("threat_count"),
        F.sum(points).alias("cumulative_score"),
        (F.sum(points) >= 8.0).alias("flagged"),
        (F.sum(points) >= 12.0).alias("blocked"),
    )
