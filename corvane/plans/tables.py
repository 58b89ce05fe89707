"""Audit, feedback and promotion tables made from the driver's events and labels, on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(texts: DataFrame) -> DataFrame:
    """Deals texts out to all cores if their files make fewer parts than that: screening costs far
    more than moving a text. On large inputs the scan has parts enough and nothing moves."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "ts AS timestamp",
        "concat('ws', user_id % 3) AS workspace_id",
        "user_id AS session_id",
        "concat('Project ', initcap(event_type), ' seen by User', user_id % 5) AS input_text",
        "CASE WHEN event_id % 4 = 0 THEN 'output' ELSE 'input' END AS scan_target",
        "CASE event_id % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'strict' ELSE 'research' END AS policy_profile",
        "CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'purchase' THEN 'REDACT' WHEN 'signup' THEN 'FLAG' ELSE 'ALLOW' END AS action",
        "CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'signup' THEN 'LOW' ELSE 'NONE' END AS severity",
        "CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN 'pending' ELSE 'none' END AS review_status",
        "CASE event_id % 5 WHEN 0 THEN 'Ana' WHEN 1 THEN 'bo' ELSE '' END AS review_assignee",
        "CASE event_type WHEN 'error' THEN array('Injection Detector', 'PII Detector') WHEN 'purchase' THEN array('PII Detector') WHEN 'signup' THEN array('Abuse Detector') ELSE cast(array() AS array<string>) END AS triggered_agents",
        "concat(event_type, ' ', props) AS reason",
        "value AS processing_time_ms",
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").filter("toxic = 1 OR quality = 0").selectExpr(
        "doc_id AS id",
        "doc_id AS audit_log_id",
        "date_add(DATE '2024-01-01', cast(doc_id % 20 AS int)) AS timestamp",
        "CASE WHEN toxic = 1 THEN 'false_negative' ELSE 'false_positive' END AS feedback_type",
        "concat('should relax override rule \"Blue Heron ', doc_id % 3, '\" for team', doc_id % 4) AS notes",
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").selectExpr("item_id AS id", "concat('ws', item_id % 3) AS workspace_id", "CASE WHEN item_id % 2 = 0 THEN 'rule' ELSE 'preset' END AS item_type", "substring(text, 1, 20) AS note")


#: The same tables as DuckDB common table expressions.
CTE = """
audit AS (SELECT event_id AS id, ts AS "timestamp", 'ws' || (user_id % 3) AS workspace_id, user_id AS session_id,
  'Project ' || upper(event_type[1]) || event_type[2:] || ' seen by User' || (user_id % 5) AS input_text,
  CASE WHEN event_id % 4 = 0 THEN 'output' ELSE 'input' END AS scan_target,
  CASE event_id % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'strict' ELSE 'research' END AS policy_profile,
  CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'purchase' THEN 'REDACT' WHEN 'signup' THEN 'FLAG' ELSE 'ALLOW' END AS action,
  CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'signup' THEN 'LOW' ELSE 'NONE' END AS severity,
  CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN 'pending' ELSE 'none' END AS review_status,
  CASE event_id % 5 WHEN 0 THEN 'Ana' WHEN 1 THEN 'bo' ELSE '' END AS review_assignee,
  CASE event_type WHEN 'error' THEN ['Injection Detector', 'PII Detector'] WHEN 'purchase' THEN ['PII Detector'] WHEN 'signup' THEN ['Abuse Detector'] ELSE []::VARCHAR[] END AS triggered_agents,
  event_type || ' ' || props AS reason, value AS processing_time_ms FROM events),
feedback AS (SELECT doc_id AS id, doc_id AS audit_log_id, (DATE '2024-01-01' + (doc_id % 20)::INT)::DATE AS "timestamp",
  CASE WHEN toxic = 1 THEN 'false_negative' ELSE 'false_positive' END AS feedback_type,
  'should relax override rule "Blue Heron ' || (doc_id % 3) || '" for team' || (doc_id % 4) AS notes
  FROM labels WHERE toxic = 1 OR quality = 0),
both_ AS (SELECT f.*, a.workspace_id, a.triggered_agents, a.severity, a.policy_profile, a.input_text FROM feedback f JOIN audit a ON a.id = f.audit_log_id),
promotions AS (SELECT item_id AS id, 'ws' || (item_id % 3) AS workspace_id, CASE WHEN item_id % 2 = 0 THEN 'rule' ELSE 'preset' END AS item_type, text[1:20] AS note FROM benchmark)
"""
