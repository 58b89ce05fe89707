"""Analytics over the audit, feedback and promotion tables.

``audit``: id, timestamp, workspace_id, session_id, input_text, scan_target,
policy_profile, action, severity, review_status, review_assignee, triggered_agents
(array), reason, processing_time_ms. ``feedback``: id, audit_log_id, timestamp,
feedback_type, notes. Time-dependent operators take ``as_of``; there is no clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.dialect import escaped

EQUALITY = ("action", "severity", "scan_target", "review_status", "policy_profile", "workspace_id")


def like_pattern(part: str) -> str:
    """``%part%`` as it is: ``%`` and ``_`` in it keep their meaning."""
    return f"%{part}%"


def recent(audit: DataFrame, limit: int = 50, search: str | None = None, **equal: str) -> DataFrame:
    """Newest rows that equal the given columns and contain ``search`` in reason or text, whatever its case."""
    d = audit
    for name, value in equal.items():
        if name not in EQUALITY:
            raise ValueError(f"no such filter: {name}")
        if value is not None:
            d = d.filter(F.col(name) == value)
    if search:
        d = d.filter(F.col("reason").ilike(like_pattern(search)) | F.col("input_text").ilike(like_pattern(search)))
    return d.orderBy(F.desc("id")).limit(limit)


def review_queue(audit: DataFrame, limit: int = 50, assignee: str | None = None, **equal: str) -> DataFrame:
    """Newest pending rows; the assignee filter applies to what the limit leaves."""
    d = recent(audit, limit, review_status="pending", **equal)
    return d.filter(F.lower("review_assignee").contains(assignee.lower())) if assignee else d


def stats(audit: DataFrame, as_of: str) -> DataFrame:
    """``metric, key, value``: totals, counts by action, severity, target and profile, mean time, blocks in the last hour.

    One pass: grouping sets instead of one query for each metric."""
    keys = ["action", "severity", "scan_target", "policy_profile"]
    at = F.lit(as_of).cast("timestamp")
    blocked = F.sum(F.when((F.col("action") == "BLOCK") & (F.col("timestamp") >= at - F.expr("INTERVAL 1 HOUR")), 1).otherwise(0))
    sets = audit.groupingSets([[F.col(k)] for k in keys] + [[]], *keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("processing_time_ms"), 2).alias("ms"), blocked.alias("blocked"), *[F.grouping(k).alias(f"g_{k}") for k in keys]
    )
    named = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.lit(f"by_{k}")) for k in keys])
    by = sets.filter(named.isNotNull()).select(named.alias("metric"), F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.col(k)) for k in keys]).alias("key"), F.col("n").cast("double").alias("value"))
    whole = sets.filter(named.isNull()).select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit("").alias("key"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for m, c in (("total", "n"), ("avg_processing_time_ms", "ms"), ("blocked_last_hour", "blocked"))])).alias("x")
    )
    return by.unionByName(whole.select("x.*"))


def age_bucket(hours: Column) -> Column:
    return F.when(hours < 1, "under_1h").when(hours < 24, "1h_to_24h").when(hours < 168, "1d_to_7d").otherwise("over_7d")


def review_analytics(audit: DataFrame, as_of: str) -> DataFrame:
    """``metric, key, value`` of pending rows by age, assignee and severity."""
    hours = F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 3.6e9, F.lit(0.0))
    d = audit.filter(F.col("review_status") == "pending")
    who = F.coalesce(F.nullif(F.col("review_assignee"), F.lit("")), F.lit("unassigned"))
    each = F.array(
        F.struct(F.lit("age").alias("metric"), age_bucket(hours).alias("key")),
        F.struct(F.lit("assignee").alias("metric"), who.alias("key")),
        F.struct(F.lit("severity").alias("metric"), F.coalesce("severity", F.lit("NONE")).alias("key")),
    )
    return d.select(F.explode(each).alias("x")).groupBy("x.metric", "x.key").agg(F.count(F.lit(1)).alias("value"))


def joined(feedback: DataFrame, audit: DataFrame) -> DataFrame:
    a = audit.select(F.col("id").alias("_id"), "workspace_id", "triggered_agents", "severity", "policy_profile", "input_text")
    return feedback.join(a, F.col("audit_log_id") == F.col("_id")).drop("_id")


def feedback_summary(feedback: DataFrame, audit: DataFrame, workspace: str | None = None) -> DataFrame:
    d = feedback
    if workspace is not None:
        d = d.join(audit.filter(F.col("workspace_id") == workspace), F.col("audit_log_id") == audit["id"], "left_semi")
    return d.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"))


#: Fixed values. Words that say nothing about a note.
NOTE_STOP_WORDS = ("false", "positive", "negative", "should", "would", "there", "because")


def hotspot_agents(both: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent ``type:agent`` labels; ties go to the label seen first, newest feedback first."""
    d = both.select("id", "feedback_type", F.posexplode("triggered_agents").alias("at", "agent"))
    label = F.concat_ws(":", "feedback_type", "agent")
    return _top(d, label, "label", limit)


def hotspot_terms(both: DataFrame, limit: int = 8) -> DataFrame:
    token = F.regexp_extract_all(F.lower(F.coalesce("notes", F.lit(""))), F.lit("[a-z][a-z0-9_]{3,}"), F.lit(0))
    d = both.select("id", F.posexplode(token).alias("at", "term")).filter(~F.col("term").isin(*NOTE_STOP_WORDS))
    return _top(d, F.col("term"), "term", limit, 2)


def _top(d: DataFrame, key: Column, name: str, limit: int, least: int = 1) -> DataFrame:
    counted = d.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct((-F.col("id")).alias("i"), "at")).alias("_first"))
    return counted.filter(F.col("count") >= least).orderBy(F.desc("count"), "_first").limit(limit).drop("_first")


def insight_counts(both: DataFrame) -> DataFrame:
    each = F.array(
        F.struct(F.lit("feedback_type").alias("metric"), F.col("feedback_type").alias("key")),
        F.struct(F.lit("severity").alias("metric"), F.col("severity").alias("key")),
        F.struct(F.lit("policy_profile").alias("metric"), F.coalesce(F.nullif("policy_profile", F.lit("")), F.lit("balanced")).alias("key")),
    )
    return both.select(F.explode(each).alias("x")).groupBy("x.metric", "x.key").agg(F.count(F.lit(1)).alias("value"))


def policy_adjustments(both: DataFrame, limit: int = 8) -> DataFrame:
    d = both.select("id", "feedback_type", F.coalesce("policy_profile", F.lit("balanced")).alias("profile"), F.coalesce("severity", F.lit("LOW")).alias("severity"), F.posexplode("triggered_agents").alias("at", "agent"))
    counted = d.groupBy("profile", "agent", "feedback_type", "severity").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct((-F.col("id")).alias("i"), "at")).alias("_first"))
    false_alarm = F.col("feedback_type") == "false_positive"
    advice = F.when(false_alarm, F.concat(F.lit("Allow more for "), "agent", F.lit(" in profile "), "profile")).otherwise(F.concat(F.lit("Tighten "), "agent", F.lit(" in profile "), "profile"))
    priority = F.when(F.col("count") >= F.when(false_alarm, 3).otherwise(2), "HIGH").otherwise("MEDIUM")
    return counted.orderBy(F.desc("count"), "_first").limit(limit).select("profile", "agent", "feedback_type", "severity", "count", priority.alias("priority"), advice.alias("recommendation"))


def reviewer_timeline(both: DataFrame, limit_days: int = 14) -> DataFrame:
    """Feedback by day and type, newest first; the limit counts rows, three for each day."""
    d = both.groupBy(F.to_date("timestamp").alias("day"), "feedback_type").agg(F.count(F.lit(1)).alias("total"))
    return d.orderBy(F.desc("day"), "feedback_type").limit(limit_days * 3)


def mined_rules(both: DataFrame, limit: int = 5, newest: int = 200) -> DataFrame:
    """Phrases of missed texts that recur: capitalised words and quoted parts, as rule suggestions."""
    d = both.filter(F.col("feedback_type") == "false_negative").orderBy(F.desc("id")).limit(newest)
    text = F.concat_ws(" ", F.coalesce("input_text", F.lit("")), F.coalesce("notes", F.lit("")))
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,2}\b"), F.lit(0)),
        F.regexp_extract_all(text, F.lit('"([^"]{4,60})"'), F.lit(1)),
    )
    d = d.select("id", "input_text", F.posexplode(found).alias("at", "p")).withColumn("phrase", F.btrim("p")).filter(F.length("phrase") >= 4)
    first = F.struct((-F.col("id")).alias("i"), F.col("at").alias("at"))
    counted = d.groupBy("phrase").agg(F.count(F.lit(1)).alias("support"), F.min(first).alias("_first"), F.min_by("input_text", first).alias("example"))
    top = counted.orderBy(F.desc("support"), "_first").limit(limit)
    return top.select(
        F.concat(F.lit("Suggested rule: "), F.substring("phrase", 1, 40)).alias("name"),
        escaped(F.col("phrase")).alias("pattern"),
        F.when(F.col("support") == 1, "MEDIUM").otherwise("HIGH").alias("severity"),
        "support",
        "example",
    )


def promotion_history(promotions: DataFrame, limit: int = 50, workspace: str | None = None) -> DataFrame:
    d = promotions if workspace is None else promotions.filter(F.col("workspace_id") == workspace)
    return d.orderBy(F.desc("id")).limit(limit)


def reviewed(audit: DataFrame, events: DataFrame) -> DataFrame:
    """Latest review status, assignee and notes of each audit row, from append-only review events (id, seq, status, assignee, notes)."""
    last = events.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("status", "assignee", "notes"), "seq").alias("_e"))
    d = audit.join(last, F.col("id") == F.col("_id"), "left")
    return d.withColumns({"review_status": F.coalesce("_e.status", "review_status"), "review_assignee": F.coalesce("_e.assignee", "review_assignee")}).drop("_id", "_e")


def audit_rows(decisions: DataFrame, id_column: str, timestamp: Column) -> DataFrame:
    """Decisions in the shape of the audit table: texts redacted and cut, the whole redacted text hashed."""
    from corvane.operators.decide import redacted

    safe = redacted(F.coalesce("text", F.lit("")), F.col("triggered_agents"), F.col("scan_target"), F.col("workspace_id"))
    session = F.col("session_id") if "session_id" in decisions.columns else F.lit(None)
    return decisions.withColumn("_safe", safe).select(
        F.col(id_column).alias("id"), timestamp.alias("timestamp"), "workspace_id", session.cast("string").alias("session_id"), F.substring("_safe", 1, 500).alias("input_text"),
        "scan_target", "policy_profile", "action", "severity", F.when(F.col("action") == "ALLOW", "none").otherwise("pending").alias("review_status"), F.lit("").alias("review_assignee"),
        F.lit("").alias("review_notes"), "triggered_agents", F.substring("reason", 1, 500).alias("reason"), F.to_json("matched_threats").alias("matched_threats"), F.sha2("_safe", 256).alias("input_hash"),
    )


def running_counts(audit: DataFrame, rows: int = 200) -> DataFrame:
    """Agents over the newest rows, most frequent first."""
    d = audit.orderBy(F.desc("id")).limit(rows).select(F.explode("triggered_agents").alias("agent"))
    return d.groupBy("agent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "agent").limit(5)


def running_days(audit: DataFrame, rows: int = 200) -> DataFrame:
    """Entries of each day among the newest rows."""
    return audit.orderBy(F.desc("id")).limit(rows).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def per_minute_excess(requests: DataFrame, limit: int, by: str = "user_id", at: str = "ts") -> DataFrame:
    """Callers over ``limit`` requests in a fixed minute."""
    minute = F.date_trunc("minute", at)
    return requests.groupBy(by, minute.alias("minute")).agg(F.count(F.lit(1)).alias("requests")).filter(F.col("requests") > limit)


def feedback_for(feedback: DataFrame, entry: int) -> DataFrame:
    """An audit entry's feedback, newest first."""
    return feedback.filter(F.col("audit_log_id") == entry).orderBy(F.desc("id"))


def submitted(feedback: DataFrame, audit: DataFrame, new: DataFrame) -> DataFrame:
    """The feedback table with new rows in it that are of a known type and refer to an audit entry."""
    good = new.filter(F.col("feedback_type").isin("false_positive", "false_negative")).join(audit.select(F.col("id").alias("audit_log_id")), "audit_log_id", "left_semi")
    return feedback.unionByName(good.select(*feedback.columns))


def clear(spark: SparkSession, path: str, where: str = "true") -> int:
    """Deletes the rows of a parquet table for which ``where`` holds, all by default; returns how many.

    What stays is written beside the table first and then takes its place, so a run that
    breaks off leaves the old table.
    """
    old = spark.read.parquet(path)
    gone = old.filter(where).count()
    if gone:
        new = path.rstrip("/") + "-kept"
        old.filter(f"NOT coalesce({where}, false)").write.mode("overwrite").parquet(new)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(folder(path), True)
        files.rename(folder(new), folder(path))
        spark.catalog.refreshByPath(path)
    return gone
