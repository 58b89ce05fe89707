"""Rule tables and vector collections of any size against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import cache, govern, rule_index, vector_index

WORDS = ["ignore", "previous", "instruction", "Straße", "KELVIN K", "token", "a1", "xyz", "Ünï", "ſecret", "line\nbreak", "s3"]


def rows(rng, n):
    return [" ".join(rng.choice(WORDS, int(rng.integers(0, 12)))) for _ in range(n)]


PATTERNS = [
    "ignore.*previous", "instruct(ion)?s?", r"\btoken\s+(\w+)", "a1|xyz", "k", "[0-9]+", "secret", "(broken", "", "kelvin k", "previous instruction", "stra(ss|ß)e", "line.break", "x{2}", r"^\s*$", "(?i:TOKEN)", "nothing here at all",
    "xy", "s3", "a" * 40, r"ignore\s+previous", r"token[ \n]+a1\s*", r"xyz\s*s3", r"line\s*?\s+break", r"\stoken", r"previous  instruction|s3 \s*a1", r"(line|token)\s(break|s3)", None, "previous", "previous",
]


def brute(texts, rules, blank):
    flags = re.IGNORECASE | re.DOTALL
    out = []
    for t, text in texts:
        for r, pattern, exceptions in rules:
            try:
                p = re.compile(pattern, flags) if pattern is not None else None
            except re.error:
                p = None
            if p is None or text is None or not (blank or text.strip()):
                continue
            every = list(p.finditer(text))
            vetoes = [e for e in exceptions or [] if e != "(bad"]
            if every and not any(re.search(e, text, flags) for e in vetoes):
                out.append((t, r, (every[0][min(1, p.groups)] or "")[:120], len(every)))
    return sorted(out)


@pytest.mark.parametrize("block, blank", [(20_000, False), (4, True)])
def test_rules_equal_brute_force(spark, block, blank):
    rng = np.random.default_rng(4)
    texts = list(enumerate([*rows(rng, 120), None, "", "  ", "token " * 40_000, "a" * 50]))
    rules = [(k, p, [None, [], ["xyz", "(bad"], ["s3"]][k % 4]) for k, p in enumerate(PATTERNS)]
    t = spark.createDataFrame(texts, "t int, text string").repartition(3)
    r = spark.createDataFrame(rules, "r int, pattern string, exceptions array<string>")
    got = sorted((x.t, x.r, x.evidence, x.match_count) for x in rule_index.match_rules(t, r, blank, block).collect())
    assert got == brute(texts, rules, blank)


def test_scope_and_workspace_hold_where_both_tables_have_them(spark):
    texts = spark.createDataFrame([(1, "token", "input", "a"), (2, "token", "output", "b")], "t int, text string, scan_target string, workspace_id string")
    rules = [("both", "both", None), ("in", "input", "global"), ("mine", "both", "a"), ("theirs", "output", "a")]
    r = spark.createDataFrame([(n, "TOKEN", s, w) for n, s, w in rules], "n string, pattern string, scope string, workspace_id string")
    got = rule_index.match_rules(texts, r)
    assert sorted((x.t, x.n) for x in got.collect()) == [(1, "both"), (1, "in"), (1, "mine"), (2, "both")]
    assert got.columns == ["t", "text", "scan_target", "workspace_id", "evidence", "match_count", "n", "pattern", "scope"]


def test_signatures_of_no_or_disabled_entries(spark):
    texts = spark.createDataFrame([(1, "token"), (2, None)], "t int, text string")
    entries = spark.createDataFrame([("e", "token", False), ("f", "tok", True)], "id string, pattern string, enabled boolean")
    assert [x.id for x in rule_index.match_signatures(texts, entries).collect()] == ["f"]
    assert rule_index.match_signatures(texts, entries.filter("false")).count() == 0


def test_no_nested_loop_and_few_patterns_are_run(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"an order of item number {k:05d} for you") for k in range(300)], "t int, text string")
    rules = spark.createDataFrame([(k, rf"item\s+number {k:05d}\b") for k in range(5000)], "r int, pattern string")
    got = rule_index.match_rules(texts, rules)
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    assert sorted((x.t, x.r) for x in got.collect()) == [(k, k) for k in range(300)]
    index = rule_index.Index.of([(bytes([k % 256]), rf"item\s+number {k:05d}\b", []) for k in range(5000)])
    raw = b" an order of item number 00042 for you "
    assert len(list(index.held(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))) == 1


def test_large_rule_tables_are_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "SENT", 10)
    texts = spark.createDataFrame([(1, "x{y"), (2, "abc")], "t int, text string")
    rules = spark.createDataFrame([("a", "abc"), ("b", "abc"), ("c", r"x\{")], "r string, pattern string")
    assert sorted((x.t, x.r) for x in rule_index.match_rules(texts, rules).collect()) == [(1, "c"), (2, "a"), (2, "b")]


def test_rules_are_validated_without_a_bound(spark):
    r = spark.createDataFrame([("1", "n", "(", "LOW", "d", None), ("2", "n", "a", "LOW", "d", ["x", "[", "("]), ("3", "n", "a", "low", "d", []), (None, "n", "a", "LOW", "d", [])], "id string, name string, pattern string, severity string, description string, exceptions array<string>")
    got = {x.id: (x.valid, x.error) for x in govern.validated(r).collect()}
    assert got["3"] == (True, None) and got[None][1] == "Missing required field: 'id'"
    assert got["1"][1].startswith("Invalid regex pattern: ") and got["2"][1].startswith("Invalid exception pattern '[': ")


def test_upsert_takes_the_last_of_repeated_ids(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("a", 5, 2), ("a", 9, 1), ("c", 1, 1), ("c", None, 3), (None, 4, 1)], "id string, v int, seq int")
    assert sorted(tuple(r) for r in govern.upsert(old, new, order="seq").collect()) == [("a", 5, "updated"), ("b", 2, "kept"), ("c", None, "added")]


# vectors


def vectors(rng, n, dim=16, clusters=12):
    middle = rng.normal(size=(clusters, dim))
    return middle[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.3, 2.0], (n, 1))


def brute_nearest(queries, known, limit):
    out = {}
    for q, v in queries:
        best = min(((round(1 - float(v @ k / np.linalg.norm(v) / np.linalg.norm(k)), 9), i) for i, k in known), default=None)
        if best is not None and best[0] <= limit:
            out[q] = (best[1], round(best[0], 6))
    return out


@pytest.mark.parametrize("small, block", [(2000, 100), (0, 100), (0, 7), (0, 16_384)])
def test_nearest_equals_brute_force(spark, small, block):
    rng = np.random.default_rng(9)
    known = list(enumerate(vectors(rng, 500)))
    known += [(1000, known[3][1]), (1001, known[3][1] * 2)]
    queries = list(enumerate(vectors(np.random.default_rng(9), 150) + rng.normal(size=(150, 16)) * 0.1))
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0] * 3), (9004, [None] * 16), (9005, []), (9006, [float("inf")] * 16)]
    frame = lambda rows: spark.createDataFrame([(k, v if v is None or isinstance(v, list) else v.tolist()) for k, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got = vector_index.nearest(frame([*queries, *odd]), frame([*odd, *known]), 0.15, small, block=block)
    assert {r.vec_id: (r.cached_id, r.distance) for r in got.collect()} == brute_nearest(queries, known, 0.15)


def test_cells_pass_over_what_is_far_and_empty_sides(spark):
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors(np.random.default_rng(2), 60))], "vec_id long, embedding array<double>")
    assert vector_index.nearest(d, d.limit(0), 0.5).count() == 0
    assert vector_index.nearest(d.limit(0), d, 0.5, 0).count() == 0
    zero = d.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0)))
    assert vector_index.nearest(d, zero, 0.5, 0).count() == 0
    assert {r.vec_id: r.cached_id for r in vector_index.nearest(d, d, 0.0001, 0).collect()} == {k: k for k in range(60)}


@pytest.mark.parametrize("small", [2000, 0])
def test_recalled_keeps_each_row_once(spark, small):
    near = lambda far: [1 - far, float(np.sqrt(1 - (1 - far) ** 2)), 0.0]
    texts = spark.createDataFrame([(1, "a", near(0.14)), (1, "b", near(0.16)), (1, "c", [0.0, 0.0, 0.0]), (None, "d", near(0.14)), (2, "e", None), (3, "f", [0.0, 0.09, 1.0])], "vec_id long, text string, embedding array<double>")
    threats = spark.createDataFrame([(7, [1.0, 0.0, 0.0], "INJECTION", "HIGH", "x"), (8, [0.0, 0.0, 0.0], "ABUSE", "LOW", "x"), (7, [1.0, 0.0, 0.0], "ABUSE", "LOW", "x")], "vec_id long, embedding array<double>, threat_type string, severity string, source_agent string")
    allowed = spark.createDataFrame([(5, [0.0, 0.0, 2.0], "fine")], "vec_id long, embedding array<double>, reason string")
    got = {r.text: r for r in cache.recalled(texts, threats, allowed, small=small).collect()}
    assert len(got) == 6 and cache.recalled(texts, threats, allowed, small=small).count() == 6
    assert {k for k, r in got.items() if r.cached_threat} == {"a", "d"} and got["a"].cached_threat.severity == "HIGH"
    assert {k for k, r in got.items() if r.allow_reason} == {"f"}
