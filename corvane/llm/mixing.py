"""Mixing sources to target weights by weighted fair queueing.

Every document, shuffled inside its source, gets a virtual finish time: the
source's cumulative size up to and with it, divided by the source's target. A
mix that serves finish times in ascending order gives each source its weighted
share at any moment; it is cut where the total budget is used up. A source may
be read up to ``repeats`` times, each time after the last.

Distribution: sizes and shuffle keys are computed in one scan and written
narrow. Cumulative sizes are two-level prefix sums over (source, slice of the
key space), so a hot source spreads over all slices. The cut in the global order
is found by range buckets of the finish time, refined until the bucket that holds
the cut is small; only that bucket is sorted.

Edge cases: null text has size 0 and is never taken; null sources sort last and
form a source of their own; rows equal in id, key and size are interchangeable;
of equal finish times all or none are served; a very long text counts whole; an
empty table gives no rows; only ``doc_id``, ``text``, ``source`` and the columns to
carry are read, and no other column's name matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import count_space_words, materialize, running_sums

#: Rows that one slice of a source should hold, and buckets in each pass that looks for the cut.
SLICE_ROWS = 4096
BUCKETS = 4096
#: The bucket with the cut is sorted once it has so few rows.
SORTED_ROWS = 20_000


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sources: DataFrame, repeats: int = 3) -> DataFrame:
    """Targets of sources from ``source, source_size``: weights 1, 2, 3 in code-point order,
    null last; none above ``repeats`` times its size, the excess shared again by weight.

    Closed form: in ascending order of limit per weight the limited sources come
    first, so running sums decide. Both orders are dealt by ranges, so sources may be
    as many as hosts.
    """
    t = running_sums(sources, [F.col("source").asc_nulls_last()], {"_before": F.lit(1)}, "source-places")
    t = t.withColumn("_place", F.col("_before") + 1).withColumn("weight", (F.col("_before") % 3 + 1).cast("long")).drop("_before")
    t = t.withColumn("_limit", F.col("source_size") * repeats).withColumn("_ratio", F.col("_limit") / F.col("weight"))
    t = running_sums(t, [F.col("_ratio").asc(), F.col("_place").asc()], {"_limits": F.col("_limit"), "_lighter": F.col("weight")}, "source-limits")
    size, weights = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    t = t.withColumn("_level", (F.lit(size) - F.col("_limits")) / (F.lit(weights) - F.col("_lighter")))
    t = t.withColumn("_full", F.col("_limit") <= F.col("_level") * F.col("weight"))
    first_open = t.filter(~F.col("_full")).agg(F.min(F.struct(F.col("_ratio").alias("r"), F.col("_place").alias("p"), F.col("_level").alias("level")))).first()[0]
    level = F.lit(None if first_open is None else first_open["level"]).cast("double")
    target = F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(F.col("weight") * level)
    return t.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def fair_mix(docs: DataFrame, repeats: int = 3, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of ``docs``, and its columns ``carry``."""
    spark = docs.sparkSession
    rows = docs.select(*carry, "doc_id", "source", count_space_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key"))
    rows = materialize(rows, "mix-sizes")
    table = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), repeats)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    slices = max(16, min(65536, total["n"] // SLICE_ROWS))
    rows = rows.withColumn("_slice", F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * slices / F.lit(1 << 24)).withColumn("_slice", F.floor("_slice").cast("int"))

    # Cumulative sizes: sums of the slices before, plus a running sum inside the slice.
    sums = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("_s"), F.col("_slice").alias("_k"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy("source", "_slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_inside", inside)
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_s"]) & (rows["_slice"] == sums["_k"])).drop("_s", "_k")
    table = table.withColumnRenamed("source", "_s")
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = materialize(rows.withColumn("_upto", F.col("_before") + F.col("_inside")).drop("_slice", "_before", "_inside"), "mix-queue")

    # Finish time of each reading of each document.
    finish = lambda e: (F.col("_upto") + e * F.col("source_size")) / F.col("target")
    open_ = (F.col("size") > 0) & (F.col("target") > 0)
    served = rows.filter(open_).select("size", F.explode(F.array(*[finish(e) for e in range(repeats)])).alias("f"))
    cut = _cut(served, total["size"])
    taken = sum((F.when(open_ & (finish(e) <= F.lit(cut)), F.col("size")).otherwise(0) for e in range(repeats)), F.lit(0))
    return rows.select(*carry, "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _cut(served: DataFrame, budget: int) -> float:
    """The largest finish time such that everything served by then fits the budget.

    Range buckets of the finish time hold sums; the bucket where the budget ends is
    divided again until it is small, and only that one is sorted.
    """
    low, high, used = 0.0, served.agg(F.max("f")).first()[0], 0
    if high is None:
        return 0.0
    while True:
        width = (high - low) / BUCKETS
        part = served.filter((F.col("f") > low) & (F.col("f") <= high))
        if low + width == low:
            break
        bucket = F.least(F.floor((F.col("f") - low) / width), F.lit(BUCKETS - 1))
        held = part.groupBy(bucket.alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi"))
        over = None
        for r in sorted(held.collect()):  # BUCKETS rows at most
            if used + r["s"] > budget:
                over = r
                break
            used, low = used + r["s"], r["hi"]
        if over is None:
            return low
        high = over["hi"]
        if over["n"] <= SORTED_ROWS or over["lo"] == over["hi"]:
            break
    edge = served.filter((F.col("f") > low) & (F.col("f") <= high))
    spent = edge.groupBy("f").agg(F.sum("size").alias("s")).withColumn("spent", F.sum("s").over(Window.orderBy("f")) + used)
    last = spent.filter(F.col("spent") <= budget).agg(F.max("f")).first()[0]
    return low if last is None else last
