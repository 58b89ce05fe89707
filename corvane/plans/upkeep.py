"""Queries of rules, feeds, presets, feedback, caches and evaluation over tables made from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.operators import audit as A
from corvane.operators import cache, decide, evaluate, govern, validate
from corvane.plans.analytics import _RATES, _SCORED, _metrics_sql, _scored
from corvane.plans.tables import AS_OF, CTE, audit, feedback, read, spread

QUERIES: dict = {}
ORACLES: dict = {}

#: A rule table, one row for each document, in words that both engines read alike.
_RULE = {
    "id": "concat('r', doc_id)",
    "name": "CASE doc_id % 7 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'alpha' ELSE concat('Rule ', doc_id % 50) END",
    "pattern": "concat('p', doc_id % 11)",
    "severity": "CASE doc_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END",
    "scope": "CASE doc_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'input' ELSE 'output' END",
    "status": "CASE WHEN doc_id % 6 = 0 THEN 'draft' ELSE 'active' END",
    "workspace_id": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'global' ELSE concat('ws', doc_id % 3) END",
    "description": "coalesce(lang, '')",
    "enabled": "doc_id % 5 <> 0",
    "redact": "doc_id % 2 = 0",
}
_RULES = "rules AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RULE.items()) + ", CASE WHEN doc_id % 8 = 0 THEN ['x'] ELSE [] END AS exceptions FROM documents)"
#: Two versions of a small table: ``old`` and ``new`` share a sixth of their keys and more.
_VERSIONS = "old AS (SELECT doc_id AS id, quality AS v FROM labels WHERE doc_id % 3 <> 0), new AS (SELECT doc_id AS id, toxic + 10 AS v FROM labels WHERE doc_id % 2 = 0)"


#: A feed whose entries come up to three times, in the order of ``seq``.
_FEED = ["doc_id AS id, toxic + 10 AS v, 1 AS seq", "doc_id AS id, quality + 20 AS v, 2 AS seq", "doc_id AS id, toxic - 5 AS v, 3 AS seq"]
_FEED_ROWS = ("doc_id % 2 = 0", "doc_id % 3 = 0", "doc_id % 12 = 0")
_FEED_SQL = "feed AS (" + " UNION ALL ".join(f"SELECT {c} FROM labels WHERE {w}" for c, w in zip(_FEED, _FEED_ROWS, strict=True)) + "), last AS (SELECT id, arg_max(v, seq) AS v FROM feed GROUP BY id)"


def query(oracle: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {', '.join(tables)} {oracle}" if tables else oracle
        return f

    return add


def _rules(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.selectExpr(*[f"{e} AS {n}" for n, e in _RULE.items()], "CASE WHEN doc_id % 8 = 0 THEN array('x') ELSE cast(array() AS array<string>) END AS exceptions")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "labels")
    return d.filter("doc_id % 3 <> 0").selectExpr("doc_id AS id", "quality AS v"), d.filter("doc_id % 2 = 0").selectExpr("doc_id AS id", "toxic + 10 AS v")


# Rules, feeds, presets


@query("SELECT id, name FROM rules WHERE enabled AND status <> 'draft' AND scope IN ('both', 'input') AND workspace_id IN ('', 'global', 'ws1')", _RULES)
def rules_in_force(spark, sf_dir):
    return govern.rules_in_force(_rules(spark, sf_dir), "input", "ws1").select("id", "name")


@query("SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), pattern, scope, workspace_id ORDER BY id) AS n FROM rules) WHERE n = 1 ORDER BY lower(name), id LIMIT 25", _RULES)
def distinct_rules(spark, sf_dir):
    return govern.distinct_rules(_rules(spark, sf_dir)).select("id", "name")


@query("""SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), pattern, scope, workspace_id ORDER BY id) AS n FROM rules)
  WHERE n = 1 AND severity = 'HIGH' AND contains(lower(name || ' ' || pattern || ' ' || description), 'p1') ORDER BY lower(name), id LIMIT 25""", _RULES)  # fmt: skip
def found_rules(spark, sf_dir):
    return govern.distinct_rules(_rules(spark, sf_dir), "P1", "HIGH").select("id", "name")


@query("""SELECT count(*) AS total_rules, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (redact) AS redact_enabled, count(*) FILTER (len(exceptions) > 0) AS with_exceptions FROM rules WHERE enabled""", _RULES)  # fmt: skip
def rule_stats(spark, sf_dir):
    return govern.rule_stats(_rules(spark, sf_dir))


@query("SELECT id, CASE WHEN id = 'r5' THEN true ELSE enabled END AS enabled FROM rules WHERE id <> 'r7'", _RULES)
def rule_edits(spark, sf_dir):
    return govern.deleted(govern.toggled(_rules(spark, sf_dir), "r5", True), "r7").select("id", "enabled")


@query("SELECT coalesce(last.id, old.id) AS id, coalesce(last.v, old.v) AS v, CASE WHEN old.id IS NULL THEN 'added' WHEN last.id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM old FULL JOIN last ON old.id = last.id", _VERSIONS, _FEED_SQL)
def feed_upsert(spark, sf_dir):
    """A feed that holds entries more than once; the last counts."""
    labels = read(spark, sf_dir, "labels")
    one, two, three = (labels.filter(w).selectExpr(*c.split(", ")) for c, w in zip(_FEED, _FEED_ROWS, strict=True))
    return govern.upsert(_versions(spark, sf_dir)[0], one.unionByName(two).unionByName(three), order="seq")


@query("SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)", _VERSIONS)
def preset_overlay(spark, sf_dir):
    return govern.overlay(*_versions(spark, sf_dir), "id")


@query("""SELECT doc_id AS name, 'v' AS field, quality::VARCHAR AS before, (quality + 1)::VARCHAR AS after FROM labels WHERE doc_id % 9 = 0
  UNION ALL SELECT doc_id, 'w', toxic::VARCHAR, NULL FROM labels WHERE doc_id % 14 = 0""")
def draft_diff(spark, sf_dir):
    base = read(spark, sf_dir, "labels").selectExpr("doc_id AS name", "quality AS v", "toxic AS w")
    draft = base.selectExpr("name", "CASE WHEN name % 9 = 0 THEN v + 1 ELSE v END AS v", "CASE WHEN name % 14 = 0 THEN null ELSE w END AS w")
    return govern.draft_diff(base, draft)


_PROFILES = [*sorted(C.COMPLIANCE), "balanced"]
_PROFILE_OF = f"CASE event_id % {len(_PROFILES)} " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PROFILES)) + " END"
_TERMS = ", ".join(f"('{n}', {p.retention_days})" for n, p in C.COMPLIANCE.items())


@query(f"SELECT event_id FROM (SELECT event_id, ts, {_PROFILE_OF} AS p FROM events) LEFT JOIN (VALUES {_TERMS}) t(n, days) ON p = n WHERE days IS NULL OR ts >= TIMESTAMP '{AS_OF}' - to_days(days)")
def retained_rows(spark, sf_dir):
    """Events that their compliance profile still lets be kept."""
    d = read(spark, sf_dir, "events").selectExpr("event_id", "ts", f"{_PROFILE_OF} AS policy_profile")
    return govern.retained(d, AS_OF, "ts").select("event_id")


# Feedback


@query("SELECT id, feedback_type FROM feedback WHERE audit_log_id = 7 ORDER BY id DESC", CTE)
def feedback_of_entry(spark, sf_dir):
    return A.feedback_for(feedback(spark, sf_dir), 7).select("id", "feedback_type")


@query("""SELECT id, audit_log_id, feedback_type FROM feedback UNION ALL
  SELECT doc_id + 1000000, doc_id * 3, CASE WHEN toxic = 1 THEN 'false_negative' ELSE 'false_positive' END FROM labels WHERE (toxic = 1 OR doc_id % 2 = 0) AND doc_id * 3 IN (SELECT id FROM audit)""", CTE)  # fmt: skip
def feedback_submitted(spark, sf_dir):
    """Rows of an unknown type, or for an entry that isn't there, are refused."""
    old = feedback(spark, sf_dir)
    kind = "CASE WHEN toxic = 1 THEN 'false_negative' WHEN doc_id % 2 = 0 THEN 'false_positive' ELSE 'odd' END AS feedback_type"
    new = read(spark, sf_dir, "labels").selectExpr("doc_id + 1000000 AS id", "doc_id * 3 AS audit_log_id", "DATE '2024-01-01' AS timestamp", kind, "'' AS notes")
    return A.submitted(old, audit(spark, sf_dir), new).select("id", "audit_log_id", "feedback_type")


# Evaluation


@query(f"SELECT lang, round(100 * (0.25 * precision + 0.25 * recall + 0.5 * f1 - least(n / 1000.0, 0.2)), 6) AS score FROM (SELECT lang, n, {_RATES} FROM m)", _SCORED, f"m AS (SELECT lang, count(*) AS n, {_metrics_sql()} FROM s GROUP BY lang)")
def leaderboard(spark, sf_dir):
    """Languages ranked as variants are, their size in place of the latency."""
    d = evaluate.binary_metrics(_scored(spark, sf_dir), F.col("truth"), F.col("score") >= 0.2, "lang").withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    score = F.round(evaluate.weighted_score(F.col("precision"), F.col("recall"), F.col("f1"), F.col("n").cast("double")), 6)
    return d.select("lang", score.alias("score")).orderBy(F.desc("score"), "lang")


@query(f"SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(avg(accuracy), 4) AS macro_accuracy FROM (SELECT {_RATES} FROM m)", _SCORED, f"m AS (SELECT lang, {_metrics_sql()} FROM s GROUP BY lang)")
def macro_averages(spark, sf_dir):
    return evaluate.macro_averages(evaluate.binary_metrics(_scored(spark, sf_dir), F.col("truth"), F.col("score") >= 0.2, "lang"))


@query("""SELECT count(*) AS n, count(*) FILTER (id % 2 = 0) AS opened, count(*) FILTER (list_has_any(triggered_agents, ['Injection Detector', 'Unsafe Content Detector'])) AS model_triggered,
  count(*) FILTER (id % 2 = 1 AND action <> 'ALLOW') AS stopped_without_model FROM audit""", CTE)  # fmt: skip
def gate_efficiency(spark, sf_dir):
    return evaluate.gate_efficiency(audit(spark, sf_dir).withColumn("gate_open", F.col("id") % 2 == 0))


@query("SELECT id, CASE WHEN processing_time_ms >= 85 THEN 'BLOCK' WHEN processing_time_ms >= 60 THEN 'REDACT' WHEN processing_time_ms >= 30 THEN 'FLAG' ELSE 'ALLOW' END AS action FROM audit", CTE)
def score_actions(spark, sf_dir):
    return audit(spark, sf_dir).select("id", decide.score_to_action(F.col("processing_time_ms")).alias("action"))


@query("""SELECT agent, count(*) AS n, round(avg(ms), 4) AS mean, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99, round(1000 * count(*) / sum(ms), 4) AS per_second
  FROM (SELECT unnest(triggered_agents) AS agent, processing_time_ms AS ms FROM audit) GROUP BY agent""", CTE)  # fmt: skip
def latency_by_agent(spark, sf_dir):
    d = audit(spark, sf_dir).select(F.explode("triggered_agents").alias("agent"), F.col("processing_time_ms").alias("ms"))
    return evaluate.percentiles(d, "ms", "agent").withColumns({"per_second": F.round(evaluate.throughput(F.col("mean")), 4), "mean": F.round("mean", 4)})


@query(r"""SELECT lang, sum(len(list_intersect(a, b)))::BIGINT AS tp, sum(len(b) - len(list_intersect(a, b)))::BIGINT AS fp, sum(len(a) - len(list_intersect(a, b)))::BIGINT AS fn FROM
  (SELECT lang, list_distinct(regexp_extract_all(text, '[0-9]+')) AS a, list_distinct(regexp_extract_all(text, '[0-9]{2,}|[A-Z]{2,}')) AS b FROM documents) GROUP BY lang""")
def value_metrics_by_kind(spark, sf_dir):
    values = lambda pattern: F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    d = read(spark, sf_dir, "documents").select("lang", values("[0-9]+").alias("a"), values("[0-9]{2,}|[A-Z]{2,}").alias("b"))
    return evaluate.value_metrics(d, "a", "b", "lang").select("lang", "tp", "fp", "fn")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def first_shuffled(spark, sf_dir):
    return evaluate.first_shuffled(read(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@query("""SELECT 'd' || doc_id AS id, 'golden' AS origin FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('golden:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 12
  UNION ALL SELECT 'b' || item_id, 'canary' FROM benchmark""")
def golden_set(spark, sf_dir):
    """A stratified sample with all canary rows."""
    sample = evaluate.stratified(read(spark, sf_dir, "documents").select("doc_id", "lang"), 12, "doc_id", "lang").selectExpr("concat('d', doc_id) AS id")
    return evaluate.with_canaries(sample, read(spark, sf_dir, "benchmark").selectExpr("concat('b', item_id) AS id"))


@query("""SELECT strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT * FROM audit ORDER BY id DESC LIMIT 200) GROUP BY 1""", CTE)
def dashboard_days(spark, sf_dir):
    return A.running_days(audit(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS cache_key, doc_id AS inserted FROM documents ORDER BY doc_id DESC LIMIT 500")
def cache_newest(spark, sf_dir):
    """What a first-in-first-out cache of 500 entries still holds of all insertions."""
    return cache.newest(read(spark, sf_dir, "documents").selectExpr("cast(doc_id AS string) AS cache_key", "doc_id AS inserted"))


# Checks of requests and saved rows


def _length_sql(name: str, required: bool, least: int | None, most: int | None) -> str:
    missing = f"WHEN {name} IS NULL THEN '{name} is missing' " if required else ""
    few = f"WHEN length({name}) < {least} THEN '{name} must have at least {least} characters' " if least else ""
    many = f"WHEN length({name}) > {most} THEN '{name} must have at most {most} characters' " if most else ""
    return f"CASE {missing}{few}{many}END"


_REQUEST = {"text": "CASE WHEN doc_id % 17 = 0 THEN null WHEN doc_id % 19 = 0 THEN '' ELSE text END", "policy_profile": "CASE WHEN doc_id % 13 = 0 THEN '' ELSE source END", "workspace_id": "CASE WHEN doc_id % 11 = 0 THEN repeat('w', 101) ELSE lang END"}
_REQUEST_SQL = "requests AS (SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in _REQUEST.items()) + " FROM documents)"


@query(f"""SELECT doc_id, error, error IS NULL AS valid FROM (SELECT doc_id, coalesce({_length_sql("text", True, 1, 100_000)}, {_length_sql("policy_profile", False, 1, 100)}, {_length_sql("workspace_id", False, 1, 100)}) AS error FROM requests)""", _REQUEST_SQL)
def request_faults(spark, sf_dir):
    """Documents as requests, some of them faulty; whole texts beyond the greatest length are found at every size."""
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", *[f"{e} AS {n}" for n, e in _REQUEST.items()])
    return validate.checked(d, "analyze").select("doc_id", "error", "valid")


_RULE_FORM = f"""coalesce({_length_sql("name", True, 1, 100)}, {_length_sql("pattern", True, 1, 500)}, {_length_sql("description", True, 1, 200)},
  CASE WHEN severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN 'severity must be one of LOW, MEDIUM, HIGH, CRITICAL' END,
  CASE WHEN scope NOT IN ('input', 'output', 'both') THEN 'scope must be one of input, output, both' END, {_length_sql("workspace_id", False, 1, 100)})"""


@query(f"SELECT id, error, error IS NULL AS valid FROM (SELECT id, {_RULE_FORM} AS error FROM rules)", _RULES)
def rule_faults(spark, sf_dir):
    """Rules of the made table that can't be saved: those without a description or workspace."""
    return validate.checked(_rules(spark, sf_dir), "rule").select("id", "error", "valid")


_PRESET = {"name": "CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END", "session_flag_threshold": "value", "session_block_threshold": "value * 2 - 20", "allowlist_max_severity": "CASE user_id % 6 WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'NOISE' END"}
_RANGES = " ".join(f"WHEN {n} < 0 THEN '{n} must be at least 0' WHEN {n} > 100 THEN '{n} must be at most 100'" for n in ("session_flag_threshold", "session_block_threshold"))


@query(f"""SELECT event_id, error, error IS NULL AS valid FROM (SELECT event_id, coalesce({_length_sql("name", True, 1, 100)}, CASE {_RANGES} END,
  CASE WHEN allowlist_max_severity NOT IN ('NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN 'allowlist_max_severity must be one of NONE, LOW, MEDIUM, HIGH, CRITICAL' END) AS error
  FROM (SELECT event_id, {", ".join(f"{e} AS {n}" for n, e in _PRESET.items())} FROM events))""")
def preset_faults(spark, sf_dir):
    d = read(spark, sf_dir, "events").selectExpr("event_id", *[f"{e} AS {n}" for n, e in _PRESET.items()])
    return validate.checked(d, "preset").select("event_id", "error", "valid")


_EXACT = "count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 95, 99))


@query(f"SELECT 'all' AS kind, {_EXACT} FROM events UNION ALL SELECT event_type, {_EXACT} FROM events GROUP BY event_type")
def exact_latencies(spark, sf_dir):
    """Exact percentiles of one group of all rows and of each kind, found by ranges and never in one task."""
    d = read(spark, sf_dir, "events")
    one = evaluate.exact_percentiles(d.withColumn("kind", F.lit("all")), "value", "kind")
    by = evaluate.exact_percentiles(d.withColumnRenamed("event_type", "kind"), "value", "kind")
    return one.unionByName(by).select("kind", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


VARIANTS = {
    "full": decide.Settings(),
    "no gate": decide.Settings(gate_enabled=False),
    "no models": decide.Settings(model_detectors=False),
    "no ensemble": decide.Settings(ensemble_enabled=False),
    "high gate": decide.Settings(gate_threshold=2.0),
}


@query()
def ablation_variants(spark, sf_dir):
    """Five variants of the engine over all labelled documents; toxic ones are to be found."""
    labels = read(spark, sf_dir, "labels").filter("toxic IS NOT NULL").select("doc_id", (F.col("toxic") == 1).alias("bad"))
    texts = spread(read(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"))
    return evaluate.ablation(texts, VARIANTS, "bad")


# Saving


_OLD_PRESETS = "'p' || (doc_id % 60) AS name, 'ws' || (doc_id % 3) AS workspace_id, max(doc_id % 9)::DOUBLE AS session_flag_threshold FROM documents GROUP BY 1, 2"
_NEW_PRESETS = {"name": "CASE WHEN event_id % 50 = 0 THEN '  ' ELSE concat(' p', user_id % 80, ' ') END", "workspace_id": "CASE WHEN event_id % 4 = 3 THEN '' ELSE concat('ws', event_id % 4) END", "session_flag_threshold": "value * 1.5 - 10", "seq": "event_id"}


@query(f"""SELECT coalesce(l.name, o.name) AS name, coalesce(l.workspace_id, o.workspace_id) AS workspace_id, coalesce(l.v, o.session_flag_threshold) AS session_flag_threshold,
  CASE WHEN l.name IS NULL THEN 'kept' WHEN o.name IS NULL THEN 'added' ELSE 'updated' END AS change FROM old_presets o FULL JOIN last_presets l ON o.name = l.name AND o.workspace_id = l.workspace_id""",
  f"old_presets AS (SELECT {_OLD_PRESETS})", f"new_presets AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _NEW_PRESETS.items())} FROM events)",
  """last_presets AS (SELECT trim(name) AS name, CASE WHEN workspace_id = '' THEN 'global' ELSE workspace_id END AS workspace_id, arg_max(session_flag_threshold, seq) AS v FROM new_presets
    WHERE trim(name) <> '' AND session_flag_threshold BETWEEN 0 AND 100 GROUP BY 1, 2)""")  # fmt: skip
def presets_saved(spark, sf_dir):
    """Presets by name and workspace; some of those to be saved are faulty, and the last of each counts."""
    d = read(spark, sf_dir, "documents").selectExpr("concat('p', doc_id % 60) AS name", "concat('ws', doc_id % 3) AS workspace_id", "doc_id % 9 AS v")
    old = d.groupBy("name", "workspace_id").agg(F.max("v").cast("double").alias("session_flag_threshold"))
    new = read(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in _NEW_PRESETS.items()])
    return govern.stored(old, new, "preset", ["name", "workspace_id"], "seq")


@query("""SELECT coalesce(l.id, o.id) AS id, coalesce(l.pattern, o.pattern) AS pattern, coalesce(l.severity, o.severity) AS severity, CASE WHEN l.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'added' ELSE 'updated' END AS change
  FROM (SELECT id, pattern, severity FROM rules) o FULL JOIN (SELECT 'r' || (doc_id + 100) AS id, source AS pattern, 'HIGH' AS severity FROM documents WHERE source IS NOT NULL AND doc_id % 3 <> 0) l ON o.id = l.id""", _RULES)  # fmt: skip
def signatures_saved(spark, sf_dir):
    """Signatures; a third of those to be saved have an unknown severity or a pattern that doesn't compile."""
    d = read(spark, sf_dir, "documents")
    new = d.selectExpr("concat('r', doc_id + 100) AS id", "'n' AS name", "CASE WHEN doc_id % 6 = 0 THEN '(' ELSE source END AS pattern", "CASE WHEN doc_id % 6 = 3 THEN 'high' ELSE 'HIGH' END AS severity")
    return govern.stored(_rules(spark, sf_dir).select("id", "pattern", "severity"), new, "signature", ["id"])


_STRICT, _CONSENT = ([n for n, p in C.COMPLIANCE.items() if getattr(p, a)] for a in ("strict", "consent"))
_ANY = lambda names: ", ".join(f"'{n}'" for n in names)


@query(f"""SELECT event_id, p IN ({_ANY(_STRICT)}) OR event_type IN ('error', 'purchase', 'signup') AS log_decision, p IN ({_ANY(_STRICT)}) AS explain_decision, p IN ({_ANY(_CONSENT)}) AS needs_consent
  FROM (SELECT event_id, event_type, {_PROFILE_OF} AS p FROM events)""")
def compliance_obligations(spark, sf_dir):
    d = read(spark, sf_dir, "events").selectExpr("event_id", f"{_PROFILE_OF} AS policy_profile", "CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN 'BLOCK' ELSE 'ALLOW' END AS action")
    return govern.obligations(d).select("event_id", "log_decision", "explain_decision", "needs_consent")
