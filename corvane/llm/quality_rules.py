"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the text, so the whole verdict runs
in the JVM next to the scan: no shuffle, no user function, one row in and one
row out. Edge cases: a null or empty text has no words, fails the base rules
and is not kept; rows are judged one by one, so ties, repeated rows and clashing
extra columns change nothing (only ``doc_id`` and ``text`` are read); a very long
text is measured whole; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, space_words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served, lower case.
STOP_WORDS = (
    "the of and to in is that it for as with was on are by be this from at or an he she they we you not but have had "
    "le la les de des du et un une en que qui dans pour pas sur est au aux par avec plus ce se "
    "der die das und ist nicht ein eine zu mit von den dem des im auf sich für als auch es an wie "
    "el los las una unos y por con para su al lo como más pero sus o"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if ``metric`` is below ``least`` or above ``most``."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("bars", "bar_word_ratio", None, 0.2),
    Rule("capitals", "upper_ratio", None, 0.5),
    Rule("repeated_lines", "dup_line_ratio", None, 0.6),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
)


def _no_fewer_than_one(x: Column) -> Column:
    return F.greatest(x, F.lit(1)).cast("double")


def _repeated(words: Column) -> Column:
    """Places of the three-word windows that stand more than once, by sorting the windows themselves."""
    one = lambda i: F.struct(F.concat_ws(" ", *(F.get(words, i + k) for k in range(3))).alias("w"), i.alias("i"))
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), one))

    def within(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["w"] == F.get(s, j)["w"], F.lit(False))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k + 1) | (k > 0) & same(k, F.greatest(k - 1, F.lit(0)))), lambda k: F.get(s, k)["i"])

    return F.get(F.transform(F.array(ordered), within), F.lit(0))


def base_metrics(docs: DataFrame) -> DataFrame:
    """Adds the counts that the rules are written in.

    Repeated windows: each window becomes one long, its hash in the high bits and
    its place in the low bits; after sorting, equal windows are neighbours, and
    neighbours count only if their words agree. Where two different windows have one
    hash, the text's windows are sorted by their words instead, so counts are exact.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", text.alias("_t"), space_words(F.col("text")).alias("_w"))
    low = F.length(F.bin(F.size("_w").cast("long")))
    mark = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    packed = F.when(
        F.size("_w") >= 3,
        F.transform(F.sequence(F.lit(0).cast("long"), (F.size("_w") - 3).cast("long")), lambda i: F.call_function("shiftleft", mark(i), F.col("_b")).bitwiseOR(i)),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = step.select("*", low.alias("_b"))
    step = step.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.sort_array(packed).alias("_s"),
    )
    differ = lambda k: F.call_function("shiftrightunsigned", F.get("_s", k).bitwiseXOR(F.get("_s", k + 1)), F.col("_b"))
    last = F.size("_s") - 2
    step = step.withColumn("_k", F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: differ(k) == 0)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b")) - 1
    place = lambda k: F.get("_s", k).bitwiseAND(F.col("_m")).cast("int")
    step = step.withColumn("_m", mask)
    step = step.withColumn("_p", F.coalesce(F.transform("_k", lambda k: F.struct(place(k).alias("a"), place(k + 1).alias("b"))), F.array()))
    word = lambda i, n: F.get("_w", i + n)
    real = F.filter("_p", lambda p: (word(p["a"], 0) == word(p["b"], 0)) & (word(p["a"], 1) == word(p["b"], 1)) & (word(p["a"], 2) == word(p["b"], 2)))
    places = F.when(F.size(real) == F.size("_p"), F.flatten(F.transform(real, lambda p: F.array(p["a"], p["b"])))).otherwise(_repeated(F.col("_w")))
    covered = F.flatten(F.transform(F.array_distinct(places), lambda i: F.array(i, i + 1, i + 2)))
    return step.select(
        "doc_id",
        "_t",
        "_w",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_p") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_repeat_words"),
    )


def ratios(metrics: DataFrame) -> DataFrame:
    """Adds the ratios that the threshold table names; needs ``base_metrics``."""
    words, chars = _no_fewer_than_one(F.col("n_words")), _no_fewer_than_one(F.col("word_chars"))
    spelled = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    frequent = F.size(F.filter("_w", lambda w: w.isin(spelled)))
    return metrics.select(
        "*",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        ((F.length("_t") - F.length(F.replace("_t", F.lit("|"), F.lit("")))) / words).alias("bar_word_ratio"),
        (F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")) / chars).alias("upper_ratio"),
        (F.col("n_dup_lines") / _no_fewer_than_one(F.col("n_lines"))).alias("dup_line_ratio"),
        (frequent / words).alias("stop_word_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row fails."""
    checks = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (F.col(r.metric) < r.least)
        if r.most is not None:
            bad = bad | (F.col(r.metric) > r.most)
        checks.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*checks))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    d = ratios(base_metrics(docs))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("failed_rules", verdict(rules))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_t", "_w")
