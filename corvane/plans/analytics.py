"""Queries of sessions over events, audit, governance, evaluation, caches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions.dialect import java_regex
from corvane.operators import audit as A
from corvane.operators import cache, decide, evaluate, govern, rule_index, session, vector_index
from corvane.plans.tables import AS_OF, CTE, audit, feedback, promotions, read
from corvane.streaming import guard

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, tables: bool = True):
    """Registers a query; an oracle over the made tables gets their expressions, ``+`` adds more of its own."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle and tables:
            ORACLES[f.__name__] = f"WITH {CTE}, {oracle[1:]}" if oracle[0] == "+" else f"WITH {CTE} {oracle}"
        elif oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _both(spark, sf_dir) -> DataFrame:
    return A.joined(feedback(spark, sf_dir), audit(spark, sf_dir))


# Sessions over events: the user is the session, the event its turn.

_POINTS = "CASE severity WHEN 'LOW' THEN 0.5 WHEN 'MEDIUM' THEN 1.5 WHEN 'HIGH' THEN 3.0 WHEN 'CRITICAL' THEN 5.0 ELSE 0.0 END::DOUBLE"
_RANK = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"


@query(f"""SELECT id, session_id, s AS session_score, CASE WHEN s >= 12 THEN 'BLOCK' WHEN s >= 8 AND action = 'ALLOW' THEN 'FLAG' ELSE action END AS session_action
  FROM (SELECT *, sum({_POINTS}) OVER (PARTITION BY session_id ORDER BY id) AS s FROM audit)""")
def session_scores(spark, sf_dir):
    d = session.with_scores(audit(spark, sf_dir).withColumn("turn", F.col("id")))
    rank = session.threshold_action(F.col("session_score"), decide.action_rank(F.col("action")), F.lit(8.0), F.lit(12.0))
    return d.select("id", "session_id", "session_score", decide.action_name(rank).alias("session_action"))


def _event_turns(spark, sf_dir) -> DataFrame:
    types = F.when(F.col("action") == "BLOCK", F.array(F.lit("INJECTION"))).when(F.col("action") == "FLAG", F.array(F.lit("UNSAFE_CONTENT"))).otherwise(F.array().cast("array<string>"))
    d = audit(spark, sf_dir).withColumn("turn", F.col("id")).withColumn("threat_types", types)
    return d.withColumn("text", F.concat("reason", F.when(F.col("id") % 7 == 0, " password").when(F.col("id") % 11 == 0, " aws key").otherwise("")))


@query(f"""+ h AS (SELECT id, session_id, list({_RANK}) OVER w AS s, list(action) OVER w AS a, list(CASE WHEN id % 7 = 0 THEN 'password' WHEN id % 11 = 0 THEN 'api_key' END) OVER w AS c FROM audit WINDOW w AS (PARTITION BY session_id ORDER BY id ROWS 49 PRECEDING)),
  m AS (SELECT *, len(s) AS n, list_filter(list_zip(s, a), lambda x: x[2] = 'BLOCK') AS inj, list_filter(list_zip(s, a), lambda x: x[2] = 'FLAG') AS uns,
    list_aggregate(CASE WHEN len(s) >= 5 THEN s[-5:] ELSE s END, 'avg') AS recent, list_aggregate(s[:3], 'avg') AS early, len(list_distinct(c)) AS creds FROM h)
  SELECT id, creds >= 2 AS probing, len(uns) >= 2 AS phased, n >= 3 AND recent / greatest(early, 0.1) > 1.5 AS escalating FROM m""")
def session_patterns(spark, sf_dir):
    d = session.patterns(_event_turns(spark, sf_dir))
    has = lambda k: F.exists("patterns", lambda p: p["type"] == k)
    return d.select("id", has("credential_probing").alias("probing"), has("phased_unsafe_content").alias("phased"), has("severity_escalation").alias("escalating"))


@query()
def session_patterns_all(spark, sf_dir):
    d = session.patterns(_event_turns(spark, sf_dir))
    return d.select("id", F.array_join(F.transform("patterns", lambda p: F.concat_ws(":", p["type"], p["severity"], p["confidence"], p["occurrences"])), ",").alias("patterns"))


@query(f"""SELECT session_id, count(*) AS message_count, sum((action IN ('BLOCK', 'FLAG'))::INT)::BIGINT AS threat_count, sum({_POINTS}) AS cumulative_score, sum({_POINTS}) >= 8 AS flagged, sum({_POINTS}) >= 12 AS blocked FROM audit GROUP BY session_id""")
def session_summaries(spark, sf_dir):
    return session.summaries(_event_turns(spark, sf_dir))


@query("""SELECT id, array_to_string(list(reason) OVER (PARTITION BY session_id ORDER BY id ROWS 3 PRECEDING), ' ') AS recent FROM audit""")
def cross_turn_text(spark, sf_dir):
    return _event_turns(spark, sf_dir).withColumn("text", F.col("reason")).select("id", session.recent_text().alias("recent"))


# Audit

_RECENT = "id, workspace_id, action, severity, scan_target, policy_profile, reason"


@query(f"SELECT {_RECENT} FROM audit WHERE severity = 'HIGH' AND workspace_id = 'ws1' ORDER BY id DESC LIMIT 50")
def audit_recent(spark, sf_dir):
    return A.recent(audit(spark, sf_dir), severity="HIGH", workspace_id="ws1").select(*_RECENT.split(", "))


@query(f"SELECT {_RECENT} FROM audit WHERE reason ILIKE '%K_: 1%' OR input_text ILIKE '%K_: 1%' ORDER BY id DESC LIMIT 40")
def audit_search(spark, sf_dir):
    return A.recent(audit(spark, sf_dir), 40, "K_: 1").select(*_RECENT.split(", "))


@query(f"SELECT {_RECENT} FROM (SELECT * FROM audit WHERE review_status = 'pending' ORDER BY id DESC LIMIT 60) WHERE lower(review_assignee) LIKE '%an%'")
def review_queue(spark, sf_dir):
    return A.review_queue(audit(spark, sf_dir), 60, "AN").select(*_RECENT.split(", "))


@query(f"""SELECT 'by_action' AS metric, action AS "key", count(*)::DOUBLE AS value FROM audit GROUP BY action UNION ALL SELECT 'by_severity', severity, count(*) FROM audit GROUP BY severity
  UNION ALL SELECT 'by_scan_target', scan_target, count(*) FROM audit GROUP BY scan_target UNION ALL SELECT 'by_policy_profile', policy_profile, count(*) FROM audit GROUP BY policy_profile
  UNION ALL SELECT 'total', '', count(*) FROM audit UNION ALL SELECT 'avg_processing_time_ms', '', round(avg(processing_time_ms), 2) FROM audit
  UNION ALL SELECT 'blocked_last_hour', '', count(*) FROM audit WHERE action = 'BLOCK' AND "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR""")
def audit_stats(spark, sf_dir):
    return A.stats(audit(spark, sf_dir), AS_OF)


@query(f"""+ p AS (SELECT *, greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us("timestamp")) / 3.6e9, 0) AS h FROM audit WHERE review_status = 'pending')
  SELECT 'age' AS metric, CASE WHEN h < 1 THEN 'under_1h' WHEN h < 24 THEN '1h_to_24h' WHEN h < 168 THEN '1d_to_7d' ELSE 'over_7d' END AS "key", count(*) AS value FROM p GROUP BY ALL
  UNION ALL SELECT 'assignee', CASE WHEN review_assignee = '' THEN 'unassigned' ELSE review_assignee END, count(*) FROM p GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM p GROUP BY ALL""")
def review_analytics(spark, sf_dir):
    return A.review_analytics(audit(spark, sf_dir), AS_OF)


@query("SELECT feedback_type, count(*) AS n FROM feedback WHERE audit_log_id IN (SELECT id FROM audit WHERE workspace_id = 'ws1') GROUP BY 1")
def feedback_summary(spark, sf_dir):
    return A.feedback_summary(feedback(spark, sf_dir), audit(spark, sf_dir), "ws1")


@query("SELECT f.feedback_type, count(*) AS n FROM feedback f GROUP BY 1")
def feedback_counts(spark, sf_dir):
    return A.feedback_summary(feedback(spark, sf_dir), audit(spark, sf_dir))


@query("""SELECT 'feedback_type' AS metric, feedback_type AS "key", count(*) AS value FROM both_ GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM both_ GROUP BY ALL UNION ALL SELECT 'policy_profile', policy_profile, count(*) FROM both_ GROUP BY ALL""")
def feedback_insights(spark, sf_dir):
    return A.insight_counts(_both(spark, sf_dir))


@query("""+ x AS (SELECT id, feedback_type || ':' || unnest(triggered_agents) AS label, generate_subscripts(triggered_agents, 1) AS i FROM both_)
  SELECT label, "count" FROM (SELECT label, count(*) AS "count", min((-id, i)) AS f FROM x GROUP BY label) ORDER BY "count" DESC, f LIMIT 5""")
def hotspot_agents(spark, sf_dir):
    return A.hotspot_agents(_both(spark, sf_dir))


@query("""+ x AS (SELECT id, unnest(r) AS term, generate_subscripts(r, 1) AS i FROM (SELECT id, regexp_extract_all(lower(notes), '[a-z][a-z0-9_]{3,}') AS r FROM both_))
  SELECT term, "count" FROM (SELECT term, count(*) AS "count", min((-id, i)) AS f FROM x WHERE term NOT IN ('false', 'positive', 'negative', 'should', 'would', 'there', 'because') GROUP BY term) WHERE "count" > 1 ORDER BY "count" DESC, f LIMIT 8""")
def hotspot_terms(spark, sf_dir):
    return A.hotspot_terms(_both(spark, sf_dir))


_ADJUST = """x AS (SELECT id, feedback_type, policy_profile AS profile, severity, unnest(triggered_agents) AS agent, generate_subscripts(triggered_agents, 1) AS i FROM both_),
  adj AS (SELECT profile, agent, feedback_type, severity, n AS "count" FROM (SELECT profile, agent, feedback_type, severity, count(*) AS n, min((-id, i)) AS f FROM x GROUP BY ALL) ORDER BY n DESC, f LIMIT 8)"""


@query(f"""+ {_ADJUST} SELECT *, CASE WHEN "count" >= CASE WHEN feedback_type = 'false_positive' THEN 3 ELSE 2 END THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM adj""")
def policy_adjustments(spark, sf_dir):
    return A.policy_adjustments(_both(spark, sf_dir)).drop("recommendation")


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, feedback_type, total FROM (SELECT "timestamp" AS d, feedback_type, count(*) AS total FROM both_ GROUP BY ALL) ORDER BY d DESC, feedback_type LIMIT 42""")
def reviewer_timeline(spark, sf_dir):
    return A.reviewer_timeline(_both(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(r"""+ n AS (SELECT * FROM both_ WHERE feedback_type = 'false_negative' ORDER BY id DESC LIMIT 200),
  t AS (SELECT id, input_text, list_concat(regexp_extract_all(input_text || ' ' || notes, '\b[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,2}\b'), regexp_extract_all(input_text || ' ' || notes, '"([^"]{4,60})"', 1)) AS r FROM n),
  x AS (SELECT id, input_text, unnest(r) AS p, generate_subscripts(r, 1) AS i FROM t),
  c AS (SELECT p, count(*) AS support, min((-id, i)) AS f, arg_min(input_text, (-id, i)) AS example FROM x WHERE length(p) >= 4 GROUP BY p)
  SELECT 'Suggested rule: ' || p[:40] AS name, replace(p, ' ', '\ ') AS pattern, CASE WHEN support = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, support, example FROM c ORDER BY support DESC, f LIMIT 5""")
def mined_rules(spark, sf_dir):
    return A.mined_rules(_both(spark, sf_dir))


@query(f"SELECT name, pattern, severity, support::INT AS support, 'Seen in ' || support || ' missed texts' AS description, 'draft' AS status, false AS enabled FROM ({ORACLES['mined_rules']})", False)
def suggested_drafts(spark, sf_dir):
    """The suggested rules as drafts."""
    return govern.draft_rules(A.mined_rules(_both(spark, sf_dir))).select("name", "pattern", "severity", "support", "description", "status", "enabled")


@query("SELECT * FROM promotions WHERE workspace_id = 'ws1' ORDER BY id DESC LIMIT 10")
def promotion_history(spark, sf_dir):
    return A.promotion_history(promotions(spark, sf_dir), 10, "ws1")


@query("""SELECT agent, count(*) AS n FROM (SELECT unnest(triggered_agents) AS agent FROM (SELECT * FROM audit ORDER BY id DESC LIMIT 200)) GROUP BY agent ORDER BY n DESC, agent LIMIT 5""")
def dashboard_agents(spark, sf_dir):
    return A.running_counts(audit(spark, sf_dir))


@query("""+ e AS (SELECT doc_id AS id, arg_max(CASE WHEN quality = 1 THEN 'resolved' ELSE 'escalated' END, toxic) AS s FROM labels GROUP BY doc_id)
  SELECT a.id, coalesce(e.s, review_status) AS review_status FROM audit a LEFT JOIN e USING (id)""")
def review_updates(spark, sf_dir):
    events = read(spark, sf_dir, "labels").selectExpr("doc_id AS id", "toxic AS seq", "CASE WHEN quality = 1 THEN 'resolved' ELSE 'escalated' END AS status", "'x' AS assignee", "'' AS notes")
    return A.reviewed(audit(spark, sf_dir), events).select("id", "review_status")


@query("""SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS "minute", count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1""", False)
def rate_limit(spark, sf_dir):
    return A.per_minute_excess(read(spark, sf_dir, "events"), 1).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


# Governance


_WORDS = "regexp_extract_all(lower(text), '[a-z]+'{0})"
#: The pattern of a text: three words of it in a row, whatever white space is between them.
_PATTERN_SQL = "w[{0}] || '[ \n]+' || w[{0} + 1] || '[ \n]+' || w[{0} + 2]"


def _patterns(texts, at: int):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    d = texts.withColumn("_w", w).filter(F.size("_w") >= at + 2)
    return d.withColumn("pattern", F.concat_ws("[ \n]+", *[F.get("_w", F.lit(at - 1 + k)) for k in range(3)])).drop("_w")


def _exceptions(spark_side: bool, key: str) -> str:
    return f"CASE WHEN {key} % 4 = 0 THEN {'array' if spark_side else ''}{'(' if spark_side else '['}'licen[sc]e', '(broken'{')' if spark_side else ']'} ELSE {'cast(array() AS array<string>)' if spark_side else '[]'} END"


@query(f"""SELECT doc_id, id, regexp_extract(text, '(?is)' || pattern)[1:120] AS evidence, len(regexp_extract_all(text, '(?is)' || pattern))::INT AS match_count
  FROM (SELECT item_id AS id, {_PATTERN_SQL.format(2)} AS pattern FROM (SELECT item_id, {_WORDS.format("")} AS w FROM benchmark) WHERE len(w) >= 4) JOIN documents
  ON contains(lower(text), regexp_extract(pattern, '[a-z]+')) AND regexp_matches(text, '(?is)' || pattern) WHERE NOT (id % 4 = 0 AND regexp_matches(text, '(?is)licen[sc]e'))""", False)
def rule_join(spark, sf_dir):
    """Rules with exceptions, one for each benchmark passage, against all documents."""
    rules = _patterns(read(spark, sf_dir, "benchmark"), 2).selectExpr("item_id AS id", "pattern", f"{_exceptions(True, 'item_id')} AS exceptions")
    return rule_index.match_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), rules).select("doc_id", "id", "evidence", "match_count")


_SCOPE = "CASE k % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'input' ELSE 'output' END"


@query(f"""WITH e AS (SELECT item_id * 10000 + k AS id, array_to_string(w[k:k + 4], ' ') AS said, {_SCOPE} AS scope
    FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM (SELECT item_id, {_WORDS.format("")} AS w FROM benchmark)) WHERE k % 5 <> 0),
  t AS (SELECT page_id, regexp_replace(lower(html), '[ \n]+', ' ', 'g') AS low, CASE WHEN page_id % 2 = 0 THEN 'input' ELSE 'output' END AS target FROM pages
    UNION ALL SELECT doc_id + 1000000000, regexp_replace(lower(text), '[ \n]+', ' ', 'g'), 'input' FROM documents)
  SELECT page_id, id FROM e JOIN t ON scope IN ('both', target) AND contains(low, said)""", False)
def signature_join(spark, sf_dir):
    """A feed with an entry for each five words of the benchmark's passages, a fifth of them off, against all pages and documents."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")).filter("size(w) >= 5")
    each = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 4)).alias("k"))
    entries = each.select((F.col("item_id") * 10000 + F.col("k")).alias("id"), F.array_join(F.slice("w", F.col("k"), F.lit(5)), "[ \n]+").alias("pattern"), F.expr(_SCOPE).alias("scope"), (F.col("k") % 5 != 0).alias("enabled"))
    pages = read(spark, sf_dir, "pages").selectExpr("page_id", "html AS text", "CASE WHEN page_id % 2 = 0 THEN 'input' ELSE 'output' END AS scan_target")
    texts = pages.unionByName(read(spark, sf_dir, "documents").selectExpr("doc_id + 1000000000 AS page_id", "text", "'input' AS scan_target"))
    return rule_index.match_signatures(texts, entries).select("page_id", "id")


@query("""SELECT source, CASE WHEN source IN ('src1') THEN 'strict' ELSE 'balanced' END AS preset, CASE WHEN source IN ('src1') THEN 6.0 ELSE 8.0 END::DOUBLE AS session_flag, count(*) AS n FROM documents GROUP BY ALL""", False)
def preset_fallback(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("policy_profile", F.when(F.col("source") == "src1", "strict").otherwise(F.col("source")))
    return govern.with_preset(d, govern.preset_table(spark)).groupBy("source", "preset", "session_flag").agg(F.count(F.lit(1)).alias("n"))


_STEPS = """event_id, CASE event_id % 4 WHEN 0 THEN 'not_requested' WHEN 1 THEN 'pending' WHEN 2 THEN 'approved' ELSE 'rejected' END AS s,
  CASE user_id % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'approve' WHEN 2 THEN 'reject' ELSE 'promote' END AS a, event_id % 3 AS asked_by, user_id % 3 AS acted"""


@query(f"""SELECT event_id, CASE WHEN a = 'request' AND s IN ('not_requested', 'rejected') THEN 'pending' WHEN a = 'approve' AND s = 'pending' AND acted <> asked_by THEN 'approved'
  WHEN a = 'reject' AND s = 'pending' AND acted <> asked_by THEN 'rejected' WHEN a = 'promote' AND s IN ('approved', 'not_requested') THEN 'promoted' END AS next FROM (SELECT {_STEPS} FROM events)""", False)
def approvals(spark, sf_dir):
    """The next approval state of each event's request, with its user as the actor."""
    d = spark.sql(f"SELECT {_STEPS} FROM {{events}}", events=read(spark, sf_dir, "events"))
    return d.select("event_id", govern.approval(F.col("s"), F.col("a"), F.col("asked_by"), F.col("acted")).alias("next"))


@query(f"""+ {_ADJUST} SELECT profile || '_draft' AS name, upper(replace(replace(agent, ' Detector', ''), ' ', '_')) AS threat_type, severity, CASE WHEN feedback_type = 'false_negative' THEN 'BLOCK' ELSE 'FLAG' END AS action,
  (CASE profile WHEN 'strict' THEN 6 WHEN 'research' THEN 10 ELSE 8 END + CASE WHEN feedback_type = 'false_negative' THEN -1 ELSE 1 END)::DOUBLE AS session_flag,
  (CASE profile WHEN 'strict' THEN 9 WHEN 'research' THEN 15 ELSE 12 END + CASE WHEN feedback_type = 'false_negative' THEN -1 ELSE 1 END)::DOUBLE AS session_block FROM adj""")
def draft_policies(spark, sf_dir):
    return govern.draft_from_adjustment(A.policy_adjustments(_both(spark, sf_dir)))


@query("SELECT id, severity FROM audit WHERE severity IN ('HIGH', 'CRITICAL')")
def alert_rows(spark, sf_dir):
    return govern.alerts(audit(spark, sf_dir)).select("id", "severity")


# Evaluation: a symbol-share score against the labels

_SCORED = r"""s AS (SELECT d.doc_id, d.lang, l.quality = 0 AS truth, least(1.0, length(regexp_replace(text, '[^#*$%&|<>!]+', '', 'g')) / greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 1)) AS score FROM documents d JOIN labels l USING (doc_id))"""


def _metrics_sql(threshold: str = "0.2") -> str:
    return f"""sum((truth AND score >= {threshold})::INT)::BIGINT AS tp, sum((NOT truth AND score >= {threshold})::INT)::BIGINT AS fp, sum((NOT truth AND score < {threshold})::INT)::BIGINT AS tn, sum((truth AND score < {threshold})::INT)::BIGINT AS fn"""


_RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 4) AS fpr, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 4) AS fnr, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 4) AS f1"""


def _scored(spark, sf_dir) -> DataFrame:
    from corvane.functions.dialect import count_of, words

    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    share = count_of(F.col("text"), "#*$%&|<>!") / F.greatest(F.size(words(F.col("text"))), F.lit(1))
    return d.select("doc_id", "lang", (F.col("quality") == 0).alias("truth"), F.least(F.lit(1.0), share).alias("score"))


@query(f"WITH {_SCORED}, m AS (SELECT lang, {_metrics_sql()} FROM s GROUP BY lang) SELECT *, {_RATES} FROM m", False)
def metrics_by_language(spark, sf_dir):
    return evaluate.binary_metrics(_scored(spark, sf_dir), F.col("truth"), F.col("score") >= 0.2, "lang")


@query(f"WITH {_SCORED}, m AS (SELECT lang, {_metrics_sql()} FROM s GROUP BY GROUPING SETS ((lang), ())) SELECT *, {_RATES} FROM m", False)
def metrics_breakdown(spark, sf_dir):
    return evaluate.breakdown(_scored(spark, sf_dir), F.col("truth"), F.col("score") >= 0.2, "lang")


@query(f"WITH {_SCORED}, m AS (SELECT threshold::DOUBLE AS threshold, {_metrics_sql('threshold')} FROM s, (VALUES (0.05), (0.1), (0.2), (0.4), (0.8)) t(threshold) GROUP BY threshold) SELECT *, {_RATES} FROM m", False)
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(_scored(spark, sf_dir), F.col("truth"), F.col("score"), (0.05, 0.1, 0.2, 0.4, 0.8))


@query(f"WITH {_SCORED} SELECT lang, sum((NOT truth AND score >= 0.2)::INT)::BIGINT AS fp, sum((truth AND score < 0.2)::INT)::BIGINT AS fn, count(*) AS total, CASE WHEN (sum((truth AND score < 0.2)::INT) - sum((NOT truth AND score >= 0.2)::INT)) / count(*) > 0.08 THEN 1.08 WHEN (sum((truth AND score < 0.2)::INT) - sum((NOT truth AND score >= 0.2)::INT)) / count(*) < -0.08 THEN 0.92 ELSE 1.0 END::DOUBLE AS slope FROM s GROUP BY lang", False)
def suggested_calibration(spark, sf_dir):
    return evaluate.suggested_calibration(evaluate.error_buckets(_scored(spark, sf_dir), F.col("truth"), F.col("score") >= 0.2, "lang")).drop("bias")


@query(f"WITH {_SCORED}, g AS (SELECT lang, (sum((truth AND score < 0.2)::INT) - sum((NOT truth AND score >= 0.2)::INT)) / count(*) AS gap FROM s GROUP BY lang) SELECT lang, (CASE WHEN gap > 0.08 THEN 1.25 WHEN gap < -0.08 THEN 0.95 ELSE 1.1 END)::DOUBLE AS weight FROM g", False)
def suggested_weights(spark, sf_dir):
    buckets = evaluate.error_buckets(_scored(spark, sf_dir), F.col("truth"), F.col("score") >= 0.2, "lang")
    return evaluate.suggested_weights(buckets, F.lit(1.1)).select("lang", "weight")


@query(f"WITH {_SCORED}, m AS (SELECT sum((NOT truth AND score >= 0.2)::INT) AS fp, sum((truth AND score < 0.2)::INT) AS fn FROM s) SELECT (CASE WHEN fn > fp THEN 1.7 WHEN fp > fn THEN 1.9 ELSE 1.8 END)::DOUBLE AS flag, (CASE WHEN fn > fp THEN 2.5 WHEN fp > fn THEN 2.7 ELSE 2.6 END)::DOUBLE AS redact, (CASE WHEN fn > fp THEN 3.4 WHEN fp > fn THEN 3.6 ELSE 3.5 END)::DOUBLE AS block FROM m", False)
def suggested_ensemble(spark, sf_dir):
    return evaluate.suggested_ensemble(evaluate.error_buckets(_scored(spark, sf_dir), F.col("truth"), F.col("score") >= 0.2, "lang"))


@query("""SELECT action, count(*) AS n, round(avg(processing_time_ms), 4) AS mean, quantile_cont(processing_time_ms, 0.5) AS p50, quantile_cont(processing_time_ms, 0.95) AS p95, quantile_cont(processing_time_ms, 0.99) AS p99 FROM audit GROUP BY action""")
def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(audit(spark, sf_dir), "processing_time_ms", "action").withColumn("mean", F.round("mean", 4))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('golden:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 12""", False)
def golden_sample(spark, sf_dir):
    return evaluate.stratified(read(spark, sf_dir, "documents").select("doc_id", "lang"), 12, "doc_id", "lang")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 150 OFFSET 50", False)
def cross_slice(spark, sf_dir):
    return evaluate.offset_slice(read(spark, sf_dir, "documents").select("doc_id"), 50, 200, "doc_id")


@query("""SELECT workspace_id, count(*) AS n, sum((action IN ('BLOCK', 'REDACT'))::INT)::BIGINT AS mitigated, round(sum((action IN ('BLOCK', 'REDACT'))::INT) / count(*), 4) AS rate FROM audit GROUP BY ALL""")
def block_rates(spark, sf_dir):
    return evaluate.block_rate(audit(spark, sf_dir), "workspace_id")


@query("SELECT session_id, max((action <> 'ALLOW')::INT) AS predicted, min(CASE WHEN action <> 'ALLOW' THEN id END) AS first_turn FROM audit GROUP BY ALL")
def session_evaluation(spark, sf_dir):
    return evaluate.session_level(audit(spark, sf_dir), "session_id", "id")


@query(f"""+ {_ADJUST}, g AS (SELECT agent, sum(least(0.1, 0.02 * "count") * CASE WHEN feedback_type = 'false_positive' THEN 1 ELSE -1 END) AS d, sum("count")::BIGINT AS n FROM adj WHERE "count" >= 2 GROUP BY agent)
  SELECT a AS agent, round(greatest(0.3, least(0.9, 0.5 + coalesce(d, 0))), 2)::DOUBLE AS suggested, coalesce(n, 0)::BIGINT AS support FROM (VALUES ('Injection Detector'), ('Unsafe Content Detector')) x(a) LEFT JOIN g ON g.agent = a""")
def tuned_thresholds(spark, sf_dir):
    return evaluate.tuned_thresholds(A.policy_adjustments(_both(spark, sf_dir)))


@query(f"""+ {_ADJUST} SELECT profile, CASE agent WHEN 'Injection Detector' THEN 'INJECTION' WHEN 'PII Detector' THEN 'PII' ELSE 'ABUSE' END AS threat_type, severity,
  CASE WHEN feedback_type = 'false_positive' THEN CASE severity WHEN 'LOW' THEN 'ALLOW' WHEN 'MEDIUM' THEN 'FLAG' ELSE 'REDACT' END ELSE CASE severity WHEN 'LOW' THEN 'FLAG' WHEN 'MEDIUM' THEN 'REDACT' ELSE 'BLOCK' END END AS action FROM adj WHERE "count" >= 2""")
def tuned_overrides(spark, sf_dir):
    return evaluate.tuned_overrides(A.policy_adjustments(_both(spark, sf_dir)))


@query(r"""SELECT sum(len(list_intersect(a, b)))::BIGINT AS tp, sum(len(b) - len(list_intersect(a, b)))::BIGINT AS fp, sum(len(a) - len(list_intersect(a, b)))::BIGINT AS fn FROM (SELECT list_distinct(regexp_extract_all(text, '[0-9]+')) AS a, list_distinct(regexp_extract_all(text, '[0-9]{2,}|[A-Z]{2,}')) AS b FROM documents)""", False)
def value_metrics(spark, sf_dir):
    """Values that two simple detectors find in whole texts."""
    values = lambda pattern: F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    d = read(spark, sf_dir, "documents").select(values("[0-9]+").alias("a"), values("[0-9]{2,}|[A-Z]{2,}").alias("b"))
    return evaluate.value_metrics(d, "a", "b").select("tp", "fp", "fn")


@query("""SELECT lang, s::DOUBLE AS saving, round(sum(length(coalesce(text, '')) // 4) / 1e6 * 0.59 * (1 - s), 6)::DOUBLE AS cost FROM documents, (VALUES (0.0), (0.65)) x(s) GROUP BY lang, s""", False)
def cost_model(spark, sf_dir):
    """What asking a model about all documents costs, by language, at four characters a token."""
    tokens = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    return evaluate.cost_model(read(spark, sf_dir, "documents").withColumn("tokens", tokens), "tokens", "lang").withColumn("cost", F.round("cost", 6))


# Caches and streams


@query(r"""SELECT md5('input:balanced:' || source || ':' || regexp_replace(text, '^\s+|\s+$', '', 'g')) AS cache_key, min(doc_id) AS doc_id, count(*) AS requests FROM documents GROUP BY 1""", False)
def response_cache(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return cache.distinct_requests(d, cache.exact_key(F.col("text"), F.lit("input"), F.lit("balanced"), F.col("source")), "doc_id")


@query(r"""SELECT k AS cache_key, min(doc_id) AS doc_id, count(*) AS requests FROM (SELECT doc_id, CASE WHEN length(p) >= 40 THEN md5('input:balanced:w:' || p) END AS k FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS p FROM documents)) GROUP BY 1""", False)
def similar_cache(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return cache.distinct_requests(d, cache.similar_key(F.col("text"), F.lit("input"), F.lit("balanced"), F.lit("w")), "doc_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts)::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT) AS n FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)),
  f AS (SELECT user_id, n, s AS since, 1 AS miss FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.n, CASE WHEN e.s - f.since < 3600 THEN f.since ELSE e.s END, CASE WHEN e.s - f.since < 3600 THEN 0 ELSE 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
  SELECT user_id, sum(miss)::BIGINT AS misses, (count(*) - sum(miss))::BIGINT AS hits FROM f GROUP BY user_id""", False)
def cache_ttl(spark, sf_dir):
    return cache.ttl_hits(read(spark, sf_dir, "events"), "user_id", "ts", 3600)


def _near_all_oracle(first: int, last: int, limit: float) -> str:
    inside = f"vec_id >= {first} AND vec_id < {last}"
    return f"""WITH c AS (SELECT vec_id AS c, embedding::DOUBLE[] AS e FROM embeddings WHERE {inside}), q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE NOT ({inside}))
  SELECT vec_id, arg_min(c, (d, c)) AS cached_id, round(min(d), 6) AS distance FROM (SELECT vec_id, c, 1 - list_cosine_similarity(q.e, c.e) AS d FROM q, c) GROUP BY vec_id HAVING min(d) <= {limit}"""


def _near_all(spark, sf_dir, first: int, last: int, limit: float) -> DataFrame:
    """Looks up all rows outside the cache."""
    d, inside = read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), f"vec_id >= {first} AND vec_id < {last}"
    return cache.nearest(d.filter(f"NOT ({inside})"), d.filter(inside), limit)


@query(_near_all_oracle(0, 50, 0.75), False)
def threat_cache(spark, sf_dir):
    return _near_all(spark, sf_dir, 0, 50, 0.75)


@query(_near_all_oracle(50, 70, 0.8), False)
def allowlist_cache(spark, sf_dir):
    return _near_all(spark, sf_dir, 50, 70, 0.8)


def _halves_sql(limit: float) -> str:
    return f"""SELECT vec_id, arg_min(c, (d, c)) AS cached_id, round(min(d), 6) AS distance FROM
  (SELECT q.vec_id, c.vec_id AS c, 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings c ON q.vec_id % 2 <> c.vec_id % 2) GROUP BY vec_id HAVING min(d) <= {limit}"""


@query(_halves_sql(0.6), False)
def vector_join(spark, sf_dir):
    """Each vector's nearest of the other half of the table, by cells whatever the size."""
    d = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    even, odd = d.filter("vec_id % 2 = 0"), d.filter("vec_id % 2 <> 0")
    return vector_index.nearest(even, odd, 0.6, small=0).unionByName(vector_index.nearest(odd, even, 0.6, small=0))


@query()
def stream_guard(spark, sf_dir):
    """Assistant turns, word by word, stopped at a card-like number or a word of the gate."""
    d = read(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.posexplode(F.split("text", "(?<= )")).alias("seq", "token"))
    return guard.guard_batch(d, java_regex(C.GATE_WORDS, "i"))


@query()
def stream_interventions(spark, sf_dir):
    """The same turns under the detectors and the policy, and what the whole pipeline says of those that went out."""
    d = read(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.posexplode(F.split("text", "(?<= )")).alias("seq", "token"))
    return guard.screened(d)


@query("""SELECT user_id, strftime(time_bucket(INTERVAL 1 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1""", False)
def rate_windows(spark, sf_dir):
    return guard.rate_limited(read(spark, sf_dir, "events"), 1).select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "requests")



