"""Evaluation: metrics, breakdowns, sweeps, percentiles, sampling, tuning suggestions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.operators import cache, decide
from corvane.operators.decide import lookup


def counts(truth: Column, predicted: Column) -> dict[str, Column]:
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return {"tp": one(truth & predicted), "fp": one(~truth & predicted), "tn": one(~truth & ~predicted), "fn": one(truth & ~predicted)}


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_metrics(d: DataFrame, digits: int | None = 4) -> DataFrame:
    """Adds precision, recall, f1, accuracy, fpr and fnr to tp, fp, tn, fn; a share of nothing is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    d = d.withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "accuracy": _share(tp + tn, tp + fp + tn + fn), "fpr": _share(fp, fp + tn), "fnr": _share(fn, fn + tp)})
    d = d.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1", "accuracy", "fpr", "fnr")
    return d if digits is None else d.withColumns({c: F.round(c, digits) for c in names})


def binary_metrics(d: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    return with_metrics(d.groupBy(*by).agg(*[c.alias(k) for k, c in counts(truth, predicted).items()]))


def breakdown(d: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """Metrics by each column and over all, in one pass of grouping sets."""
    every = d.groupingSets([[F.col(b)] for b in by] + [[]], *by)
    return with_metrics(every.agg(*[c.alias(k) for k, c in counts(truth, predicted).items()]))


def threshold_sweep(d: DataFrame, truth: Column, score: Column, thresholds: tuple[float, ...]) -> DataFrame:
    """Metrics at each threshold: rows are exploded over a fixed handful of thresholds and combined before the shuffle."""
    each = d.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return with_metrics(each.groupBy("threshold").agg(*[c.alias(k) for k, c in counts(truth, score >= F.col("threshold")).items()]))


def percentiles(d: DataFrame, value: str, *by: str, accuracy: int | None = None) -> DataFrame:
    """p50, p95 and p99: exact, by linear interpolation, in memory for each distinct value of a group; or
    with ``accuracy`` from a sketch of bounded size whose rank is off by at most 1 / accuracy."""
    at = lambda p: F.percentile(value, p / 100) if accuracy is None else F.percentile_approx(value, p / 100, accuracy)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *[at(p).alias(f"p{p}") for p in (50, 95, 99)])


def exact_percentiles(d: DataFrame, value: str, *by: str, at: tuple[int, ...] = (50, 95, 99), room: int = 100_000, cuts: int = 200) -> DataFrame:
    """``by, n, mean`` and ``p<k>`` for each of ``at``, exact by linear interpolation, for groups of any size.

    A group is counted by distinct values first. For each wanted rank its values are then
    cut into about ``cuts`` ranges, the ranges are counted, and only the one that holds the
    rank is kept, as often as it takes until no more than ``room`` distinct values are left;
    these are ranked. No task gets a group, and nothing is sorted as a whole. Nulls count as
    nowhere; a null in ``by`` is a group.
    """
    keyed = d.filter(F.col(value).isNotNull()).select(F.to_json(F.struct(F.lit(1).alias("_"), *by)).alias("_g"), *by, F.col(value).cast("double").alias("v"))
    counted = keyed.groupBy("_g", "v").agg(F.count(F.lit(1)).alias("c"))
    group = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), *[F.first(b).alias(b) for b in by])
    place = {p: (F.col("n") - 1) * p / 100 for p in at}
    wanted = group.select("_g", F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place.values()])))).alias("r"))
    wanted = wanted.select("_g", F.col("r").cast("bigint").alias("r"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("bigint").alias("before"))
    while True:
        within = (F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
        left = counted.join(wanted, "_g").filter(within)
        most = left.groupBy("_g", "r").agg(F.count(F.lit(1)).alias("values")).agg(F.max("values")).first()[0]
        if most is None or most <= room:
            break
        edges = left.groupBy("_g", "r").agg(F.percentile_approx("v", [k / cuts for k in range(1, cuts)], 100 * cuts).alias("e"))
        cell = left.join(edges, ["_g", "r"]).withColumn("cell", F.size(F.filter("e", lambda x: x < F.col("v"))))
        cells = cell.groupBy("_g", "r", "before", "cell").agg(F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy("_g", "r").orderBy("cell"))  # at most `cuts` rows each
        cells = cells.withColumn("upto", F.col("before") + upto).filter((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("c") <= F.col("r")))
        # a handful of rows for each group; written out of the plan by persisting, or each round would repeat those before
        wanted = cells.select("_g", "r", "low", "high", (F.col("upto") - F.col("c")).alias("before")).persist()
        wanted.count()
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("_g", "r").orderBy("v"))
    found = left.withColumn("upto", upto).filter((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("c") <= F.col("r"))).select("_g", "r", "v")
    one = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))  # two for each wanted percentile
    near = lambda x: F.element_at("m", x.cast("bigint"))
    between = {p: near(F.floor(x)) + (near(F.ceil(x)) - near(F.floor(x))) * (x - F.floor(x)) for p, x in place.items()}
    return group.join(one, "_g").select(*by, "n", "mean", *[c.alias(f"p{p}") for p, c in between.items()])


def throughput(mean_ms: Column) -> Column:
    """Texts a second at a mean latency, one after the other."""
    return F.when(mean_ms > 0, 1000 / mean_ms).otherwise(0.0)


def weighted_score(precision: Column, recall: Column, f1: Column, latency_ms: Column) -> Column:
    return 100 * (0.25 * precision + 0.25 * recall + 0.5 * f1 - F.least(latency_ms / 1000, F.lit(0.2)))


def stratified(d: DataFrame, per: int, key: str, *by: str, seed: str = "golden") -> DataFrame:
    """``per`` rows of each group in a seeded order; each task keeps its first ``per`` before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return d.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per).drop("_n")


def with_canaries(sample: DataFrame, canaries: DataFrame) -> DataFrame:
    """A golden set: the sample and all canary rows, ``origin`` says which; columns are matched by name."""
    return sample.withColumn("origin", F.lit("golden")).unionByName(canaries.withColumn("origin", F.lit("canary")), allowMissingColumns=True)


def offset_slice(d: DataFrame, first: int, last: int, *order: str) -> DataFrame:
    """Rows ``first`` to ``last`` of an order, without numbering the others."""
    return d.orderBy(*order).limit(last).offset(first)


def value_metrics(d: DataFrame, truth: str, found: str, *by: str) -> DataFrame:
    """Metrics over arrays of values, for each group of ``by``: those in both, only found, only true, summed over rows."""
    n = lambda c: F.sum(F.size(c)).cast("long")
    own = d.groupBy(*by).agg(n(F.array_intersect(truth, found)).alias("tp"), n(F.array_except(found, truth)).alias("fp"), F.lit(0).cast("long").alias("tn"), n(F.array_except(truth, found)).alias("fn"))
    return with_metrics(own)


def block_rate(d: DataFrame, *by: str) -> DataFrame:
    stopped = F.sum(F.when(F.col("action").isin("BLOCK", "REDACT"), 1).otherwise(0))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), stopped.alias("mitigated"), F.round(stopped / F.count(F.lit(1)), 4).alias("rate"))


def session_level(d: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Whether any turn is not allowed, and the first such turn."""
    bad = F.col("action") != "ALLOW"
    return d.groupBy(session).agg(F.max(bad.cast("int")).alias("predicted"), F.min(F.when(bad, F.col(turn))).alias("first_turn"))


def gate_efficiency(d: DataFrame) -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    model = F.arrays_overlap("triggered_agents", F.array(*map(F.lit, C.MODEL_BACKED)))
    return d.agg(F.count(F.lit(1)).alias("n"), one(F.col("gate_open"))("opened"), one(model)("model_triggered"), one(~F.col("gate_open") & (F.col("action") != "ALLOW"))("stopped_without_model"))


def cost_model(prompts: DataFrame, tokens: str, *by: str, price: float = 0.59, saved: tuple[float, ...] = (0.0, 0.65)) -> DataFrame:
    """``by, saving, cost`` of asking a model about all prompts at a price for a million tokens, without and with
    what a gate saves. One row for each group is summed before the handful of shares comes in."""
    d = prompts.groupBy(*by).agg(F.sum(tokens).alias("_tokens")).withColumn("saving", F.explode(F.array(*map(F.lit, saved))))
    return d.select(*by, "saving", (F.col("_tokens") / 1e6 * price * (1 - F.col("saving"))).alias("cost"))


def tuned_thresholds(adjustments: DataFrame, least: int = 2, base: float = 0.5) -> DataFrame:
    """Suggested confidence threshold of each model-backed detector from the adjustments' counts."""
    use = (F.col("count") >= least) & F.col("agent").isin(*C.MODEL_BACKED)
    step = F.least(F.lit(0.1), 0.02 * F.col("count")) * F.when(F.col("feedback_type") == "false_positive", 1.0).otherwise(-1.0)
    found = adjustments.filter(use).groupBy("agent").agg(F.sum(step).alias("_d"), F.sum("count").alias("support"))
    names = adjustments.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, C.MODEL_BACKED))).alias("agent"))
    d = names.join(found, "agent", "left")
    value = F.greatest(F.lit(0.3), F.least(F.lit(0.9), base + F.coalesce("_d", F.lit(0.0))))
    return d.select("agent", F.round(value, 2).alias("suggested"), F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def tuned_overrides(adjustments: DataFrame, least: int = 2) -> DataFrame:
    types = {k: v[0] for k, v in C.DETECTORS.items() if v[0] != "DOS"}
    threat = lookup(types, F.col("agent"))
    action = F.when(F.col("feedback_type") == "false_positive", lookup(C.RELAX, F.col("severity"))).otherwise(lookup(C.TIGHTEN, F.col("severity")))
    return adjustments.filter((F.col("count") >= least) & threat.isNotNull()).select("profile", threat.alias("threat_type"), "severity", F.coalesce(action, F.lit("FLAG")).alias("action"))


def _gap(d: DataFrame) -> Column:
    return (F.col("fn") - F.col("fp")) / F.greatest(F.col("total"), F.lit(1))


def suggested_calibration(buckets: DataFrame) -> DataFrame:
    """Slope and bias by how far misses outweigh false alarms."""
    gap = _gap(buckets)
    return buckets.withColumns({"slope": F.when(gap > 0.08, 1.08).when(gap < -0.08, 0.92).otherwise(1.0), "bias": F.when(gap > 0.08, 0.03).when(gap < -0.08, -0.03).otherwise(0.0)})


def suggested_weights(buckets: DataFrame, base: Column) -> DataFrame:
    gap = _gap(buckets)
    return buckets.withColumn("weight", F.round(F.when(gap > 0.08, F.least(F.lit(2.0), base + 0.15)).when(gap < -0.08, F.greatest(F.lit(0.5), base - 0.15)).otherwise(base), 3))


def suggested_ensemble(buckets: DataFrame) -> DataFrame:
    """Thresholds a step lower when misses prevail, a step higher when false alarms do, within bounds."""
    total = buckets.agg(F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    bounds = {"FLAG": (1.0, 2.5), "REDACT": (1.6, 3.4), "BLOCK": (2.5, 4.6)}
    return total.select(
        *[
            F.round(F.when(F.col("fn") > F.col("fp"), F.greatest(F.lit(lo), F.lit(C.ENSEMBLE[a] - 0.1))).when(F.col("fp") > F.col("fn"), F.least(F.lit(hi), F.lit(C.ENSEMBLE[a] + 0.1))).otherwise(F.lit(C.ENSEMBLE[a])), 3).alias(a.lower())
            for a, (lo, hi) in bounds.items()
        ]
    )


def error_buckets(d: DataFrame, truth: Column, predicted: Column, by: str) -> DataFrame:
    c = counts(truth, predicted)
    return d.groupBy(by).agg(c["fp"].alias("fp"), c["fn"].alias("fn"), F.count(F.lit(1)).alias("total"))


def macro_averages(metrics: DataFrame) -> DataFrame:
    """Means of precision, recall, F1 and accuracy over the rows of ``breakdown``, each weighing the same."""
    names = [c for c in ("precision", "recall", "f1", "accuracy") if c in metrics.columns]
    return metrics.agg(*[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in names])


def first_shuffled(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in an order that the seed fixes: a top-k, no global sort."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def _variant(decisions: DataFrame, name: str, truth: str) -> DataFrame:
    return decisions.select(F.lit(name).alias("variant"), F.col(truth).alias("t"), (F.col("action") != "ALLOW").alias("p"))


def _variants(rows: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    t, p = F.col("t"), F.col("p")
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), n(t & p).alias("tp"), n(~t & p).alias("fp"), n(~t & ~p).alias("tn"), n(t & ~p).alias("fn"))


#: Switches that variants may differ in and still share one run of the detectors.
SWITCHES = ("gate_enabled", "gate_threshold", "model_detectors", "ensemble_enabled")


def ablation(texts: DataFrame, variants: dict[str, decide.Settings], truth: str) -> DataFrame:
    """``variant, n, tp, fp, tn, fn`` of each variant of the engine's settings, in one table; a text counts
    as found if its action isn't ALLOW. ``truth`` is a boolean column.

    Variants that differ in ``SWITCHES`` alone share the detectors' results: each detector runs
    once for a text, and the decisions are made for each variant.
    """
    alike: dict[str, dict[str, decide.Settings]] = {}
    for name, settings in variants.items():
        alike.setdefault(repr(replace(settings, **{s: getattr(decide.Settings(), s) for s in SWITCHES})), {})[name] = settings
    out = None
    for own in alike.values():
        d = decide.analyze_variants(texts, own).select("variant", F.col(truth).alias("t"), (F.col("action") != "ALLOW").alias("p"))
        out = d if out is None else out.unionByName(d)
    return _variants(out)


def warmed(warm: DataFrame, test: DataFrame, truth: str, settings: decide.Settings = decide.Settings(), id_column: str = "vec_id") -> DataFrame:
    """The same table for the variants ``cold`` and ``warmed``: test texts decided without a threat cache, and with
    what the decisions on the other set taught it. Both sets have ``text`` and ``embedding``; the warm one
    may teach any number of vectors."""
    threats = cache.learned(decide.analyze(warm, settings), id_column, "embedding")
    allowed = threats.limit(0).select(id_column, "embedding", F.lit("").alias("reason"))
    known = decide.analyze(cache.recalled(test, threats, allowed, id_column), settings)
    return _variants(_variant(decide.analyze(test, settings), "cold", truth).unionByName(_variant(known, "warmed", truth)))
