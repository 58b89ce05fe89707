"""Queries of the detectors and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import catalog
from corvane.functions import constants as C
from corvane.functions.dialect import held, java_regex, quoted
from corvane.operators import decide, detect, interact, session
from corvane.plans.probes import planted, values
from corvane.plans.tables import read, spread
from corvane.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pattern: str, flags: str) -> str:
    """A Python pattern as a DuckDB literal."""
    return _lit((f"(?{flags})" if flags else "") + pattern)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.with_folded(planted(spark, sf_dir).withColumn("n", detect.normalised(F.col("text"))), "text", "n")


def _types(matches) -> F.Column:
    return F.array_join(F.transform(matches, lambda m: m["match_type"]), ",")


def _evidence(matches) -> F.Column:
    return F.array_join(F.transform(matches, lambda m: m["evidence"]), "\n")


def _search_oracle(source: str, key: str, patterns, flags: str, text: str = "text") -> str:
    """Comma-joined types of the patterns that a text has, in order."""
    parts = ", ".join(f"CASE WHEN regexp_matches(t, {_re2(p, flags)}) THEN {_lit(kind)} END" for kind, p in patterns)
    return f"SELECT {key}, array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') AS found FROM (SELECT {key}, coalesce({text}, '') AS t FROM {source})"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.with_folded(spread(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), "text")


@query("""SELECT doc_id, length(text) > 4000 AS flooding, length(text) > 10000 AS overflow, length(text) // 4 > 2500 AS inflation,
  (length(text) - length(replace(replace(text, chr(10), ''), chr(13), '')))::INT AS newlines,
  len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 2000))::INT AS long_lines,
  len(regexp_extract_all(text, 'https?://\\S+'))::INT AS urls FROM documents""")
def length_checks(spark, sf_dir):
    d, n = _texts(spark, sf_dir), F.length("text")
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.length(x) > C.ABUSE["line"]))
    from corvane.functions.dialect import count_of

    return d.select(
        "doc_id",
        (F.size(detect.flooding(F.col("text"))) > 0).alias("flooding"),
        (n > C.ABUSE["length"]).alias("overflow"),
        (F.floor(n / 4) > C.ABUSE["tokens"]).alias("inflation"),
        count_of(F.col("text"), r"\n\r").alias("newlines"),
        lines.alias("long_lines"),
        F.regexp_count("text", F.lit(r"https?://\S+")).alias("urls"),
    )


@query(r"""SELECT doc_id, round(length(regexp_replace(text, '[\p{L}\p{N}\s]+', '', 'g')) / length(text), 6) AS special,
  round(length(regexp_replace(text, '[^\p{Nd}]+', '', 'g')) / length(text), 6) AS digits,
  round(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) / greatest(length(regexp_replace(text, '[^\p{L}]+', '', 'g')), 1), 6) AS upper FROM documents WHERE length(text) > 0""")
def character_ratios(spark, sf_dir):
    d, t = _texts(spark, sf_dir).filter(F.length("text") > 0), F.col("text")
    upper = F.when(detect.letters(t) > 0, detect.upper_ratio(t)).otherwise(0.0)
    return d.select("doc_id", F.round(detect.special_ratio(t), 6).alias("special"), F.round(detect.digit_ratio(t), 6).alias("digits"), F.round(upper, 6).alias("upper"))


@query("""WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) >= 50) GROUP BY ALL),
  t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
  SELECT doc_id, round(sum(-n / total * log2(n / total)), 6) AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id""")
def text_entropy(spark, sf_dir):
    return _texts(spark, sf_dir).filter(F.length("text") >= 50).select("doc_id", F.round(detect.entropy(F.col("text")), 6).alias("entropy"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
  o AS (SELECT doc_id, x, count(*) AS n, min(i) AS i FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w) GROUP BY ALL),
  p AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w WHERE len(w) >= 3) GROUP BY ALL),
  q AS (SELECT doc_id, max(n) AS n FROM p GROUP BY doc_id)
  SELECT o.doc_id, arg_min(x, (-o.n, i)) AS top_word, max(o.n)::INT AS times, max(o.n) >= 50 AS word_attack, coalesce(any_value(q.n), 0) >= 20 AS phrase_attack
  FROM o LEFT JOIN q ON o.doc_id = q.doc_id GROUP BY o.doc_id""")
def repetition(spark, sf_dir):
    from corvane.functions.dialect import words

    d = _texts(spark, sf_dir).withColumn("w", words(F.lower("text"))).filter(F.size("w") > 0).withColumns({"t": detect.most_frequent(F.col("w")), "h": F.transform("w", lambda x: F.xxhash64(x))})
    return d.select("doc_id", F.col("t.item").alias("top_word"), F.col("t.n").alias("times"), detect.has_repeated(F.col("h"), 50).alias("word_attack"), detect.has_repeated(detect.hashed_phrases(F.col("h")), 20).alias("phrase_attack"))


@query("""WITH c AS (SELECT page_id, unnest(string_split(html, '')) AS ch, unnest(range(length(html))) AS i FROM pages),
  s AS (SELECT page_id, i, sum(CASE WHEN ch IN ('(', '[', '{') THEN 1 WHEN ch IN (')', ']', '}') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM c),
  m AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM s)
  SELECT page_id, max(depth)::INT AS depth FROM m GROUP BY page_id""")
def nesting(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", detect.nesting_depth(F.col("html")).alias("depth"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents WHERE length(text) > 0),
  s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM c),
  r AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, ch, g, count(*) AS n FROM s GROUP BY ALL) GROUP BY doc_id)
  SELECT doc_id, CASE WHEN n >= 4 THEN n ELSE 0 END::INT AS run FROM r""")
def character_runs(spark, sf_dir):
    return _texts(spark, sf_dir).filter(F.length("text") > 0).select("doc_id", detect.longest_run(F.col("text"), 4).alias("run"))


_FAMILIES = [(k, p) for k, v in catalog.ABUSE_PATTERNS.items() for p, _ in v]


def _families(d: DataFrame, key: str) -> DataFrame:
    every = F.array_compact(F.array(*[F.when(F.col("t").rlike(java_regex(p, "im" if k == "sql_injection" else "i")), F.lit(k)) for k, p in _FAMILIES]))
    return d.select(key, F.array_join(every, ",").alias("found"))


def _families_oracle(source: str, key: str, text: str) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches(t, {_re2(p, 'im' if k == 'sql_injection' else 'i')}) THEN {_lit(k)} END" for k, p in _FAMILIES)
    return f"SELECT {key}, array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') AS found FROM (SELECT {key}, {text} AS t FROM {source})"


@query(_families_oracle("pages", "page_id", "html"))
def abuse_patterns_pages(spark, sf_dir):
    return _families(read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("t")), "page_id")


@query(_families_oracle(values(), "probe_id", "text"))
def abuse_patterns_probes(spark, sf_dir):
    return _families(planted(spark, sf_dir).select("probe_id", F.col("text").alias("t")), "probe_id")


@query()
def abuse_matches(spark, sf_dir):
    d = _texts(spark, sf_dir).withColumn("m", held(detect.abuse("text")))
    return d.select("doc_id", _types(F.col("m")).alias("found"), _evidence(F.col("m")).alias("evidence"))


_PLAIN_PII = [(k, p, d) for k, p, d, _ in catalog.PII if "(?!" not in p]


def _raw_counts(d: DataFrame) -> DataFrame:
    """Patterns are searched only where the strings, or the digit, that any match holds are found."""
    counts = []
    for k, p, x in _PLAIN_PII:
        flags = detect._pii_flags(x)
        n = f"size(regexp_extract_all(text, {quoted(java_regex(p, flags))}, 0))"
        guard = detect._guard_sql("text", p, flags) + ("" if k in detect.NO_DIGIT else "has_digit AND ")
        counts.append(f"CASE WHEN text IS NULL OR ({guard[:-5]}) THEN {n} ELSE 0 END AS {k}" if guard else f"{n} AS {k}")
    return detect.with_folded(d.select("doc_id", "text", F.col("text").rlike(r"\p{Nd}").alias("has_digit")), "text").selectExpr("doc_id", *counts)


@query()
def pii_raw_counts(spark, sf_dir):
    """Of all rows, whatever their language; on non-ASCII text the dialects differ, so the test is brute force."""
    return _raw_counts(read(spark, sf_dir, "documents"))


@query("""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\\b[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}\\b'),
  lambda x: NOT regexp_matches(x, '^(test|example|dummy)@(example|test|dummy)\\.com')), ',') AS emails FROM documents""")
def pii_emails(spark, sf_dir):
    pattern = next(p for k, p, _, _ in catalog.PII if k == "email")
    return _texts(spark, sf_dir).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(java_regex(pattern, "s")), F.lit(0)), ",").alias("emails"))


@query()
def pii_matches(spark, sf_dir):
    d = _texts(spark, sf_dir).withColumn("m", detect.pii("text"))
    return d.select("doc_id", _types(F.col("m")).alias("found"), F.array_join(F.transform("m", lambda m: m["evidence"]), ",").alias("evidence"), decide.severity_name(decide.pii_severity(F.col("m"))).alias("severity"))


@query()
def pii_redaction(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.sha2(detect.redact_pii(F.col("text")), 256).alias("redacted_sha256"))


@query("SELECT probe_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {_re2(p, '')}) THEN {_lit(k)} END" for k, p, _, _ in C.SECRETS) + f"], lambda x: x IS NOT NULL), ',') AS found FROM (SELECT probe_id, text AS t FROM {values()})")
def secret_probes(spark, sf_dir):
    known = F.filter(detect.secrets("text"), lambda m: m["match_type"] != "high_entropy")
    return _probes(spark, sf_dir).select("probe_id", _types(known).alias("found"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_re2(p, '')}) THEN {_lit(k)} END" for k, p, _, _ in C.SECRETS) + "], lambda x: x IS NOT NULL), ',') AS found FROM documents")
def secret_matches(spark, sf_dir):
    known = F.filter(detect.secrets("text"), lambda m: m["match_type"] != "high_entropy")
    return _texts(spark, sf_dir).select("doc_id", _types(known).alias("found"))


@query()
def secret_findings(spark, sf_dir):
    """With random-looking credentials."""
    d = _texts(spark, sf_dir).withColumn("m", held(detect.secrets("text")))
    return d.select("doc_id", _types(F.col("m")).alias("found"), _evidence(F.col("m")).alias("evidence"))


@query()
def secret_redaction(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.sha2(detect.redact_secrets(F.col("text")), 256).alias("redacted_sha256"))


_NORMAL = r"replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\x(?:20|09|0a|0d)', ' ', 'g'), '(?i)\\u(?:0020|0009|000a|000d)', ' ', 'g'), '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), chr(0), ' ')"


@query(_search_oracle(values(), "probe_id", [(k, p) for k, p, _, _ in catalog.INJECTION], "is", _NORMAL))
def injection_probes(spark, sf_dir):
    return _probes(spark, sf_dir).select("probe_id", _types(detect.injection("n")).alias("found"))


@query(_search_oracle("documents", "doc_id", [(k, p) for k, p, _, _ in catalog.INJECTION], "is"))
def injection_documents(spark, sf_dir):
    return detect.with_folded(_texts(spark, sf_dir).withColumn("n", detect.normalised(F.col("text"))), "n").select("doc_id", _types(detect.injection("n")).alias("found"))


@query(f"SELECT probe_id, {_NORMAL} AS normalised FROM {values()}")
def injection_normalised(spark, sf_dir):
    return planted(spark, sf_dir).select("probe_id", detect.normalised(F.col("text")).alias("normalised"))


@query(_search_oracle(values(), "probe_id", [(k, p) for k, p, _, _ in catalog.UNSAFE], "is"))
def unsafe_probes(spark, sf_dir):
    return _probes(spark, sf_dir).select("probe_id", _types(detect.unsafe("text")).alias("found"))


@query(f"SELECT probe_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(text, {_re2(p, "is")}) THEN {_lit(i)} END' for i, _, p, _, _, _ in C.INTEL)}], lambda x: x IS NOT NULL), ',') AS found FROM {values()}")
def intel_probes(spark, sf_dir):
    return planted(spark, sf_dir).select("probe_id", F.array_join(F.transform(detect.intel(F.col("text"), F.col("scan_target")), lambda m: m["ref_id"]), ",").alias("found"))


RULES = (
    detect.Rule("r1", "Tea orders", r"boxes of (tea|coffee)", "MEDIUM", "POLICY WORD", redact=True),
    detect.Rule("r2", "Pirates", "pirate", "HIGH", exceptions=("summarize",), scope="input"),
    detect.Rule("r3", "Cafe in workspace", r"\bcafe\b", "LOW", workspace="ws1"),
    detect.Rule("r4", "Draft", "e", draft=True),
)


@query(f"""SELECT probe_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?is)boxes of (tea|coffee)') THEN 'r1:0.8:1' END,
  CASE WHEN scan_target = 'input' AND regexp_matches(text, '(?is)pirate') AND NOT regexp_matches(text, '(?is)summarize') THEN 'r2' END,
  CASE WHEN workspace_id = 'ws1' AND regexp_matches(text, '(?is)\\bcafe\\b') THEN 'r3:0.72:' || len(regexp_extract_all(text, '(?is)\\bcafe\\b')) END], lambda x: x IS NOT NULL), ',') AS found,
  regexp_replace(text, '(?is)boxes of (tea|coffee)', '[POLICY_WORD]', 'g') AS redacted FROM {values()}""")
def custom_rule_probes(spark, sf_dir):
    m = detect.custom_rules(F.col("text"), F.col("scan_target"), F.col("workspace_id"), RULES)
    said = F.transform(m, lambda x: F.concat_ws(":", x["ref_id"], x["confidence"], x["match_count"]))
    return planted(spark, sf_dir).select("probe_id", F.array_join(said, ",").alias("found"), detect.redact_rules(F.col("text"), F.col("scan_target"), F.col("workspace_id"), RULES).alias("redacted"))


@query(f"SELECT doc_id, CASE WHEN length(text) >= 800 THEN 1.5 ELSE 0.0 END::DOUBLE + CASE WHEN regexp_matches(text, {_re2(C.GATE_WORDS, 'i')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents")
def gate_scores(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", decide.gate_score("text", F.lit(False)).alias("score"))


def _policy_rows():
    base = [f"({_lit(t)}, {_lit(s)}, {_lit(a)})" for t, row in C.POLICY.items() for s, a in zip(("CRITICAL", "HIGH", "MEDIUM", "LOW"), row, strict=True)]
    over = [f"({_lit(p)}, {_lit(t)}, {_lit(s)}, {_lit(a)})" for p, (o, *_) in C.PRESETS.items() for t, by in o.items() for s, a in by.items()]
    return ", ".join(base), ", ".join(over)


_KINDS = [*C.POLICY, "OTHER"]


def _picked(values, place: str, spark_side: bool) -> str:
    """The value of a fixed list at ``place``, counted from 0, in either engine's words."""
    listed = ", ".join(map(_lit, values))
    return f"element_at(array({listed}), cast({place} AS int) + 1)" if spark_side else f"([{listed}])[{place} + 1]"


def _threats(spark_side: bool) -> str:
    """A threat for each event: profile, threat type, severity and confidence."""
    over, n = ("DIV" if spark_side else "//"), len(C.PRESETS)
    picked = lambda v, place: _picked(v, place, spark_side)
    return f"""event_id, {picked(C.PRESETS, f'(event_id % {n})')} AS profile, {picked(_KINDS, f'(event_id {over} {n}) % {len(_KINDS)}')} AS threat_type,
  {picked(C.SEVERITIES, f'(event_id {over} {n * len(_KINDS)}) % 5')} AS severity, least(floor(abs(value)) / 100, 1.0) AS confidence"""


@query(f"""WITH b(t, s, a) AS (VALUES {_policy_rows()[0]}), o(p, t, s, a) AS (VALUES {_policy_rows()[1]}), x AS (SELECT {_threats(False)} FROM events)
  SELECT event_id, coalesce(o.a, CASE WHEN x.severity = 'NONE' AND x.threat_type <> 'OTHER' THEN 'ALLOW' END, b.a, 'FLAG') AS action
  FROM x LEFT JOIN o ON (o.p, o.t, o.s) = (x.profile, x.threat_type, x.severity) LEFT JOIN b ON (b.t, b.s) = (x.threat_type, x.severity)""")
def policy_actions(spark, sf_dir):
    d = read(spark, sf_dir, "events").selectExpr(*_columns(_threats(True)))
    rank = decide.policy_action(F.col("profile"), F.col("threat_type"), decide.severity_rank(F.col("severity")), decide.BUILT_IN)
    return d.select("event_id", decide.action_name(rank).alias("action"))


def _columns(listed: str) -> list[str]:
    """The expressions of a SELECT list, parted at commas outside brackets."""
    out, depth, now = [], 0, ""
    for c in listed:
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def _by_type(place: int, default: float) -> str:
    return "CASE threat_type " + " ".join(f"WHEN {_lit(k)} THEN {v[place]}" for k, v in C.CALIBRATION.items()) + f" ELSE {default} END::DOUBLE"


@query(f"SELECT event_id, round(least(greatest(confidence * {_by_type(0, 1.0)} + {_by_type(1, 0.0)}, 0), 1), 4)::DOUBLE AS probability FROM (SELECT {_threats(False)} FROM events)")
def calibration(spark, sf_dir):
    d = read(spark, sf_dir, "events").selectExpr(*_columns(_threats(True)))
    return d.select("event_id", decide.calibrated(F.col("threat_type"), F.col("confidence")).alias("probability"))


@query()
def decisions(spark, sf_dir):
    """Every document's whole decision."""
    d = decide.explain(decide.analyze(spread(read(spark, sf_dir, "documents").select("doc_id", "text"))))
    return d.select("doc_id", "action", "severity", "risk_score", "risk_level", "ensemble_risk", "gate_score", "adversary_tier", F.array_join("triggered_agents", ",").alias("agents"), "reason", "confidence_level", F.sha2("redacted_text", 256).alias("redacted_sha256"))


@query()
def decision_summary(spark, sf_dir):
    return decide.analyze(spread(read(spark, sf_dir, "documents").select("doc_id", "text"))).groupBy("action", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 4).alias("mean_risk"))


@query()
def probe_decisions(spark, sf_dir):
    d = decide.explain(decide.analyze(planted(spark, sf_dir), decide.Settings(gate_enabled=False, rules=RULES)))
    return d.select(
        "probe_id", "action", "severity", "risk_score", "risk_level", "ensemble_risk", "adversary_tier", "reason", "redacted_text", "confidence_level", "recommendation",
        F.array_join(F.transform("top_findings", lambda f: f["finding"]), ",").alias("findings"), F.to_json("matched_threats").alias("matched"),
    )


@query()
def session_decisions(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'").withColumnRenamed("conv_id", "session_id")
    d = session.judge(decide.analyze(turns))
    return d.select("session_id", "turn", "action", "severity", "session_score", "cross_turn_injection", F.array_join(F.transform("patterns", lambda p: p["type"]), ",").alias("patterns"), "session_action")


@query()
def probe_sessions(spark, sf_dir):
    d = session.judge(decide.analyze(planted(spark, sf_dir).withColumn("scan_target", F.lit("input")), decide.Settings(gate_enabled=False)))
    return d.select("probe_id", "session_id", "turn", "session_score", "cross_turn_injection", F.array_join(F.transform("patterns", lambda p: F.concat_ws(":", p["type"], p["confidence"])), ",").alias("patterns"), "session_action")


@query("""SELECT conv_id, turn, nt AS output_turn, length(text) AS prompt_chars, length(n) AS output_chars FROM (SELECT *, lead(role) OVER w AS nr, lead(turn) OVER w AS nt, lead(text) OVER w AS n
  FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'""")
def interaction_pairs(spark, sf_dir):
    return interact.pairs(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "output_turn", F.length("prompt").alias("prompt_chars"), F.length("output").alias("output_chars"))


@query()
def interactions(spark, sf_dir):
    d = interact.analyze_interactions(read(spark, sf_dir, "conversations"))
    return d.select("conv_id", "turn", "combined_action", "combined_severity", F.array_join("triggered_agents", ",").alias("agents"), F.array_join("alert_types", ",").alias("alerts"), "session_risk_score", "drift_detected", "contradiction_detected")


@query(r"""WITH s AS (SELECT page_id, regexp_replace(html, '^\s+|\s+$', '', 'g') AS t FROM pages),
  m AS (SELECT page_id, t, length(regexp_replace(t, '[\p{L}\p{N}\s.,:;!?\-_/@#()\[\]''"]+', '', 'g')) / greatest(length(t), 1) AS odd FROM s)
  SELECT page_id, CASE WHEN t = '' THEN 'low' WHEN odd > 0.15 OR length(t) < 30 THEN 'low' ELSE 'medium' END AS quality FROM m""")
def extraction_quality(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", files.quality(F.col("html"), ".pdf").alias("quality"))


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:"([^"]*(?:""[^"]*)*)"?)?([^,\r\n]*)(,|\r\n|\n|\r|$)', 1)) AS q, unnest(regexp_extract_all(text, '(?:"([^"]*(?:""[^"]*)*)"?)?([^,\r\n]*)(,|\r\n|\n|\r|$)', 2)) AS p,
    unnest(regexp_extract_all(text, '(?:"([^"]*(?:""[^"]*)*)"?)?([^,\r\n]*)(,|\r\n|\n|\r|$)', 3)) AS e, unnest(range(length(text) + 2)) AS i FROM documents),
  r AS (SELECT doc_id, i, regexp_replace(replace(coalesce(q, ''), '""', '"') || p, '^\s+|\s+$', '', 'g') AS v, coalesce(sum((e <> ',')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM c WHERE e IS NOT NULL),
  l AS (SELECT doc_id, n, string_agg(v, ' | ' ORDER BY i) AS line FROM r WHERE v <> '' GROUP BY ALL),
  t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS cells FROM l GROUP BY doc_id)
  SELECT d.doc_id, coalesce(t.cells, '') AS cells FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""")
def csv_cells(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", files.csv_cells(F.col("text")).alias("cells"))
