"""Sharding by Hilbert-curve order, in DataFrame operations only.

Several metadata columns are quantised to ``bits`` bits each, every row gets its
index on the Hilbert curve through that grid, and the globally sorted order is
cut into runs of equal row counts (law ``rows``: counts at most one apart). A
shard thus covers a compact box of the grid, and its files' minima and maxima
prune on every one of the columns.

Only the key columns are sorted, never the texts: one narrow table is written,
range-partitioned by (curve index, tie columns), numbered inside each partition,
and offset by the counts of the partitions before. A hot cell is split because
the tie columns are part of the range key. The share of rows whose source or
language is smaller comes from running sums over ranges of the distinct values, so
these may be as many as hosts. Edge cases: null metadata sorts first (quantum 0);
rows equal in all keys are interchangeable; a null text has 16 bytes; a very long
text is measured and summed whole; an empty table gives no rows; columns other than
those named are not read, and whatever their names they are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, materialize, running_sums, with_row_key


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index of a grid cell on the Hilbert curve (Skilling's transform), as one expression.

    ``axes`` are columns of integers from 0 to 2^bits - 1; bits * len(axes) <= 62.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << q).cast("long").alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        own, first = F.get(x, s["i"]), F.get(x, F.lit(0))
        swap = own.bitwiseXOR(first).bitwiseAND(low)
        bit = own.bitwiseAND(s["q"]) != 0
        return F.transform(
            x,
            lambda v, k: F.when(bit, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when((k == 0) | (k == s["i"]), F.when(s["i"] == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)
            ),
        )

    x = F.aggregate(steps, F.array(*[a.cast("long") for a in axes]), turn)
    # Gray code: every axis is combined with all axes before it.
    gray = F.aggregate(x, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.element_at(F.concat(F.array(F.lit(0).cast("long")), acc), -1), F.lit(0).cast("long"))))))
    flips = F.array(*[F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1)])
    parts = F.struct(gray.alias("g"))
    flip = lambda g: F.aggregate(flips, F.lit(0).cast("long"), lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    moved = F.get(F.transform(F.array(parts), lambda p: F.transform(p["g"], lambda v: v.bitwiseXOR(flip(p["g"])))), F.lit(0))
    # Interleave: from the highest bit down, one bit of each axis in turn.
    order = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(bits - 1, -1, -1) for i in range(n)])
    folded = F.get(
        F.transform(
            F.array(F.struct(moved.alias("h"))),
            lambda p: F.aggregate(
                order, F.lit(0).cast("long"), lambda acc, s: acc * 2 + F.call_function("shiftright", F.get(p["h"], s["i"]), s["j"]).bitwiseAND(F.lit(1).cast("long"))
            ),
        ),
        F.lit(0),
    )
    return folded


def quantise_number(col: Column, low: Column, high: Column, bits: int) -> Column:
    """Equal steps between the table's least and greatest value; null is 0."""
    cells = 1 << bits
    share = F.when(high > low, (col - low) / (high - low)).otherwise(F.lit(0.0))
    return F.coalesce(F.least(F.floor(share * cells), F.lit(cells - 1)), F.lit(0)).cast("long")


def quantise_text(keys: DataFrame, name: str, bits: int, total: int) -> DataFrame:
    """Adds ``_q_<name>``: the share of the ``total`` rows whose value is smaller, in 2^bits steps.

    The join's side is left to the planner, so nothing of unchecked size is broadcast.
    """
    counts = keys.groupBy(F.coalesce(F.col(name), F.lit("")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = running_sums(counts, ["_v"], {"_smaller": F.col("_n")}, f"shares-{name}")
    codes = counts.select("_v", F.floor(F.col("_smaller") * (1 << bits) / F.lit(max(1, total))).cast("long").alias(f"_q_{name}"))
    return keys.join(codes, F.coalesce(F.col(name), F.lit("")) == F.col("_v")).drop("_v")


def equal_runs(rank: Column, total: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a rank when ``total`` rows are cut into ``shards`` runs, counts at most one apart."""
    base, more = F.floor(total / shards), total % shards
    edge = more * (base + 1)
    shard = F.when(rank < edge, F.floor(rank / (base + 1))).otherwise(more + F.floor((rank - edge) / F.greatest(base, F.lit(1))))
    slot = F.when(rank < edge, rank % (base + 1)).otherwise((rank - edge) % F.greatest(base, F.lit(1)))
    return shard.cast("int"), slot.cast("long")


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 8, key: str | None = None) -> DataFrame:
    """``doc_id, source, lang, size, text_crc32, curve, shard, slot`` for each row of ``docs``; a column
    ``key`` of it is added as ``row_key``.

    Axes: source, language and the logarithm of the size in bytes.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ids = [F.col(key).alias("row_key")] if key else []
    keys = docs.select("doc_id", "source", "lang", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), *ids)
    keys = materialize(keys, "shard-keys")
    named = keys.columns
    low, high, total = keys.agg(F.coalesce(F.min("size"), F.lit(16)), F.coalesce(F.max("size"), F.lit(16)), F.count(F.lit(1))).first()
    keys = quantise_text(quantise_text(keys, "source", bits, total), "lang", bits, total)
    grown = lambda x: F.log2(x.cast("double"))
    size_code = quantise_number(grown(F.col("size")), grown(F.lit(low)), grown(F.lit(high)), bits)
    curve = hilbert_index([F.col("_q_source"), F.col("_q_lang"), size_code], bits)
    # written, since range bounds are sampled from it first
    keys = materialize(keys.select(*named, curve.alias("curve")), "curve")
    rows = running_sums(keys, ["curve", "size", "text_crc32", "doc_id", "source", "lang"], {"_rank": F.lit(1)}, "shard-order")
    shard, slot = equal_runs(F.col("_rank"), F.lit(total), shards)
    return rows.select(*named, "curve", shard.alias("shard"), slot.alias("slot"))


def sharded(docs: DataFrame, shards: int = 40, bits: int = 8) -> DataFrame:
    """The rows of ``docs``, all columns, with their ``shard`` and ``slot``; underscores follow
    these names where ``docs`` has them itself."""
    key = fresh(docs.columns, "_key")
    shard, slot = fresh(docs.columns, "shard"), fresh(docs.columns, "slot")
    rows = with_row_key(docs, key)
    placed = hilbert_shards(rows, shards, bits, key)
    placed = placed.select(F.col("row_key").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    return rows.join(placed, key).select(*docs.columns, shard, slot)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
