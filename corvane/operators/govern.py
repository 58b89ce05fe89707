"""Rules, presets, workspaces and threat feeds as tables: filters, upserts, drafts, approvals."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import constants as C
from corvane.functions.dialect import fault, java_regex, strip
from corvane.operators import validate
from corvane.operators.decide import lookup


def tested(texts: DataFrame, rule) -> DataFrame:
    """One rule on every text: ``matched, excepted, evidence, match_count, error``."""
    from corvane.operators import detect

    text, error = F.coalesce(F.col("text"), F.lit("")), fault(rule.pattern)
    none = F.array().cast("array<string>")
    every = none if error else F.regexp_extract_all(text, F.lit(java_regex(rule.pattern, "is")), F.lit(detect._group(rule.pattern)))
    d = texts.withColumn("excepted", detect.excepted(rule, text)).withColumn("_e", F.when(F.col("excepted"), none).otherwise(every))
    said = F.coalesce(F.substring(F.get("_e", F.lit(0)), 1, 120), F.lit(""))
    return d.withColumns({"matched": F.size("_e") > 0, "evidence": said, "match_count": F.size("_e"), "error": F.when(~F.col("excepted"), F.lit(error))}).drop("_e")


def rules_in_force(rules: DataFrame, target: str, workspace: str) -> DataFrame:
    """Enabled, no draft, scope both or the target, workspace global or the given one."""
    ours = F.coalesce(F.nullif("workspace_id", F.lit("")), F.lit("global")).isin("global", workspace)
    return rules.filter(F.col("enabled") & (F.col("status") != "draft") & F.col("scope").isin("both", target) & ours)


def distinct_rules(rules: DataFrame, search: str = "", severity: str | None = None, limit: int = 25) -> DataFrame:
    """One of each (lower name, pattern, scope, workspace), the first by id; filtered, first ``limit`` by name."""
    w = Window.partitionBy(F.lower("name"), "pattern", "scope", "workspace_id").orderBy("id")
    d = rules.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    if search:
        d = d.filter(F.lower(F.concat_ws(" ", "name", "pattern", "description")).contains(search.lower()))
    if severity:
        d = d.filter(F.col("severity") == severity)
    return d.orderBy(F.lower("name"), "id").limit(limit)


def compile_error(pattern: str | None) -> str | None:
    """Why a rule's pattern doesn't compile, null if it does or is null."""
    try:
        if pattern is not None:
            re.compile(pattern, re.IGNORECASE | re.DOTALL)
    except (re.error, OverflowError, RecursionError) as bad:
        return str(bad)
    return None


@F.pandas_udf(T.StringType())
def _fault(patterns: pd.Series) -> pd.Series:
    return pd.Series([compile_error(p) for p in patterns], dtype=object)


#: Fixed values. Fields that a rule must have, in the order in which they are asked for.
RULE_FIELDS = ("id", "name", "pattern", "severity", "description")


def validated(rules: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``error``, the first reason why a rule can't be saved: a missing field, a
    pattern that doesn't compile, an unknown severity, an exception that doesn't compile."""
    d = rules.withColumn("_bad", _fault(F.col("pattern")))
    reasons = [F.when(F.col(f).isNull() if f in rules.columns else F.lit(True), F.lit(f"Missing required field: '{f}'")) for f in RULE_FIELDS]
    reasons.append(F.concat(F.lit("Invalid regex pattern: "), F.col("_bad")))
    reasons.append(F.when(~F.upper("severity").isin(*C.SEVERITIES[1:]), F.lit("severity must be one of: LOW, MEDIUM, HIGH, CRITICAL")))
    if "exceptions" in rules.columns:  # all of a rule's exceptions in one call, the first bad one comes back
        d = d.withColumn("_first", _bad_exception(F.col("exceptions")))
        reasons.append(F.concat(F.lit("Invalid exception pattern '"), F.col("_first.pattern"), F.lit("': "), F.col("_first.error")))
    d = d.withColumn("error", F.coalesce(*reasons)).drop("_bad", "_first")
    return d.withColumn("valid", F.col("error").isNull())


@F.pandas_udf(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("error", T.StringType())]))
def _bad_exception(exceptions: pd.Series) -> pd.DataFrame:
    none = (None, None)
    rows = [none if own is None else next(((e, bad) for e in own if (bad := compile_error(e)) is not None), none) for own in exceptions]
    return pd.DataFrame(rows, columns=["pattern", "error"], dtype=object)


def rule_stats(rules: DataFrame) -> DataFrame:
    """One row on the enabled rules: total, by severity, with redaction, with exceptions."""
    level = F.upper(F.coalesce("severity", F.lit("")))
    return rules.filter("enabled").agg(
        F.count(F.lit(1)).alias("total_rules"),
        *[F.count(F.when(level == s, 1)).alias(s.lower()) for s in reversed(C.SEVERITIES[1:])],
        F.count(F.when(F.col("redact"), 1)).alias("redact_enabled"),
        F.count(F.when(F.size(F.coalesce("exceptions", F.array().cast("array<string>"))) > 0, 1)).alias("with_exceptions"),
    )


def rule_id(name: Column, pattern: Column, workspace: Column) -> Column:
    """A rule's id, derived from what it is, so that saving it twice is saving it once."""
    return F.concat(F.lit("rule_"), F.substring(F.sha2(F.concat_ws("\u0000", F.lower(strip(name)), pattern, workspace), 256), 1, 12))


def saved(rules: DataFrame, new: DataFrame) -> DataFrame:
    """The rule table with valid new rules in it; the same (name, pattern, workspace) is the same rule."""
    space = F.coalesce(F.nullif("workspace_id", F.lit("")), F.lit("global"))
    own = new.withColumn("id", F.coalesce("id", rule_id(F.col("name"), F.col("pattern"), space)))
    good = validated(own).filter("valid").select(*rules.columns).dropDuplicates(["id"])
    return upsert(rules, good).drop("change")


def toggled(rules: DataFrame, rule: str, enabled: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("id") == rule, F.lit(enabled)).otherwise(F.col("enabled")))


def deleted(table: DataFrame, value: str, key: str = "id") -> DataFrame:
    """A table of rules, presets, signatures or workspaces without one entry."""
    return table.filter(~F.col(key).eqNullSafe(F.lit(value)))


def compliance_table(spark) -> DataFrame:
    """``profile, threat_type, least_severity, overrides, session_flag, session_block, retention_days``."""
    rows = [(n, t, s, p.overrides.get(t, {}), p.session_flag, p.session_block, p.retention_days) for n, p in C.COMPLIANCE.items() for t, s in p.thresholds.items()]
    return spark.createDataFrame(rows, "profile string, threat_type string, least_severity string, overrides map<string,string>, session_flag double, session_block double, retention_days int")


def compliance_presets(spark) -> DataFrame:
    """Each compliance profile as a preset row."""
    d = compliance_table(spark).groupBy("profile", "session_flag", "session_block", "retention_days").agg(F.map_from_entries(F.collect_list(F.struct("threat_type", "overrides"))).alias("action_overrides"))
    none = lambda m: F.map_filter(m, lambda _, v: F.size(v) > 0)
    return d.select(F.concat(F.lit("compliance_"), "profile").alias("name"), F.lit("compliance_profile").alias("source"), F.lit(True).alias("enabled"), "session_flag", "session_block", none("action_overrides").alias("action_overrides"), "retention_days")


def obligations(rows: DataFrame, profile: str = "policy_profile") -> DataFrame:
    """Adds what a row's compliance profile asks for: ``log_decision``, ``explain_decision``, ``redact_widely``,
    ``screen_output``, ``keep_session`` and ``needs_consent``. A row whose action isn't ALLOW is logged in any case."""
    name = F.upper(profile)
    strict = F.coalesce(name.isin(*[n for n, p in C.COMPLIANCE.items() if p.strict]), F.lit(False))
    consent = F.coalesce(name.isin(*[n for n, p in C.COMPLIANCE.items() if p.consent]), F.lit(False))
    stopped = F.coalesce(F.col("action") != "ALLOW", F.lit(False)) if "action" in rows.columns else F.lit(False)
    return rows.withColumns({"log_decision": strict | stopped, "explain_decision": strict, "redact_widely": strict, "screen_output": strict, "keep_session": strict, "needs_consent": consent})


def recommended_profile(industry: Column) -> Column:
    return lookup(C.INDUSTRIES, F.lower(industry))


def retained(rows: DataFrame, as_of: str, at: str = "timestamp", profile: str = "policy_profile") -> DataFrame:
    """Rows that their profile still lets be kept at ``as_of``; a profile without a term keeps all."""
    days = lookup({n: p.retention_days for n, p in C.COMPLIANCE.items()}, F.upper(profile))
    return rows.filter(days.isNull() | (F.col(at).cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days)))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "id", order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; ``change`` says added, updated or kept.

    Of new rows with one key the last by ``order`` counts, as if they came one after the
    other; without an order, or where it ties, the greatest row by all its columns. New rows
    without a key are passed over. ``old`` has each key once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = [c for c in new.columns if c not in keys]
    rank = F.struct(*([F.col(order).alias("_order")] if order else []), *names) if names or order else F.struct(F.lit(0).alias("_order"))
    last = new.dropna(subset=keys).groupBy(*keys).agg(F.max(rank).alias("_last"))
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in names], F.lit(True).alias("_new")).alias("b")
    d = a.join(b, reduce(and_, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]), "full_outer")
    there = F.col("b._new").isNotNull()
    change = F.when(there & F.col("a._old").isNotNull(), "updated").when(there, "added").otherwise("kept")
    pick = lambda c: F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")
    return d.select(*[pick(c).alias(c) for c in old.columns], change.alias("change"))


def stored(table: DataFrame, new: DataFrame, form: str, key: list[str], order: str | None = None) -> DataFrame:
    """A table of presets, signatures or workspaces after new rows were saved: those that pass the form's checks
    (``validate.FORMS``), whose patterns compile and whose names aren't blank; a row with a known key replaces it.

    Names are trimmed, and a blank workspace is the global one.
    """
    own = new.withColumn("name", strip(F.col("name")))
    if "workspace_id" in own.columns:
        own = own.withColumn("workspace_id", F.coalesce(F.nullif(strip(F.col("workspace_id")), F.lit("")), F.lit("global")))
    good = validate.checked(own, form).filter("valid").drop("valid", "error")
    if "pattern" in good.columns:
        good = good.filter(_fault(F.col("pattern")).isNull())
    if "allowlist_patterns" in good.columns:
        good = good.filter(_bad_exception(F.col("allowlist_patterns"))["pattern"].isNull())
    return upsert(table, good, key, order)


def overlay(built_in: DataFrame, custom: DataFrame, key: str | list[str] = "name") -> DataFrame:
    """Custom rows win over built-in ones of the same key, such as name, or name and workspace."""
    return built_in.join(custom, key, "left_anti").unionByName(custom)


def draft_rules(suggestions: DataFrame, workspace: str = "default") -> DataFrame:
    """Suggestions (``audit.mined_rules``) as rules that are off until someone promotes them."""
    said = {"description": F.concat(F.lit("Seen in "), F.col("support"), F.lit(" missed texts")), "threat_type": F.lit("CUSTOM_RULE"), "scope": F.lit("both"), "status": F.lit("draft"), "source": F.lit("feedback_suggestion"), "enabled": F.lit(False), "approval_status": F.lit("not_requested"), "workspace_id": F.lit(workspace)}
    d = suggestions.withColumns(said)
    return d.select(rule_id(F.col("name"), F.col("pattern"), F.col("workspace_id")).alias("id"), "name", "pattern", "severity", F.col("support").cast("int").alias("support"), *said)


def preset_table(spark) -> DataFrame:
    rows = [(n, f, b, t, "global") for n, (_, f, b, t) in C.PRESETS.items()]
    return spark.createDataFrame(rows, "name string, session_flag double, session_block double, model_threshold double, workspace_id string")


def with_preset(texts: DataFrame, presets: DataFrame) -> DataFrame:
    """The preset of each text; an unknown name falls back to balanced. Presets are a catalogue of
    configuration rows, left to the planner to broadcast."""
    p = presets.select(F.col("name").alias("_p"), "session_flag", "session_block", "model_threshold")
    balanced = C.PRESETS["balanced"]
    d = texts.join(p, F.col("policy_profile") == F.col("_p"), "left")
    fall = {"session_flag": balanced[1], "session_block": balanced[2], "model_threshold": balanced[3]}
    return d.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fall.items()} | {"preset": F.coalesce("_p", F.lit("balanced"))}).drop("_p")


def draft_diff(base: DataFrame, draft: DataFrame, key: str = "name") -> DataFrame:
    """``key, field, before, after`` of the fields that a draft changes."""
    fields = [c for c in draft.columns if c != key and c in base.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("before"), F.col(f"b.{c}").cast("string").alias("after")) for c in fields])
    d = base.alias("a").join(draft.alias("b"), key).select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    return d.filter(~F.col("before").eqNullSafe(F.col("after")))


def approval(state: Column, action: Column, requester: Column, actor: Column) -> Column:
    """Next approval state, null where the step isn't allowed: the approver is not the requester;
    promotion needs an approval, or that none was asked for."""
    return (
        F.when((action == "request") & state.isin("not_requested", "rejected"), "pending")
        .when((action == "approve") & (state == "pending") & (actor != requester), "approved")
        .when((action == "reject") & (state == "pending") & (actor != requester), "rejected")
        .when((action == "promote") & state.isin("approved", "not_requested"), "promoted")
    )


def draft_from_adjustment(adjustments: DataFrame) -> DataFrame:
    """A draft preset from each adjustment: misses block and lower the thresholds, false alarms flag and raise them."""
    miss = F.col("feedback_type") == "false_negative"
    threat = F.upper(F.regexp_replace(F.regexp_replace("agent", " Detector$", ""), " ", "_"))
    flag = lookup({k: v[1] for k, v in C.PRESETS.items()}, F.col("profile"))
    block = lookup({k: v[2] for k, v in C.PRESETS.items()}, F.col("profile"))
    step = F.when(miss, -1.0).otherwise(1.0)
    return adjustments.select(
        F.concat("profile", F.lit("_draft")).alias("name"), threat.alias("threat_type"), "severity", F.when(miss, "BLOCK").otherwise("FLAG").alias("action"), (flag + step).alias("session_flag"), (block + step).alias("session_block")
    )


def alerts(decisions: DataFrame, least: str = "HIGH") -> DataFrame:
    """Rows to deliver; sinks write them with ``foreachBatch`` or ``foreachPartition``."""
    return decisions.filter(F.col("severity").isin(*C.SEVERITIES[C.SEVERITIES.index(least) :]))


def workspaces(table: DataFrame) -> DataFrame:
    return table.orderBy(F.lower("name"), "name")
