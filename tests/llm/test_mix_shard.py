"""Sharding and mixing on small tables, with nulls, ties and empty input."""

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash") for i, t, lang, s in rows], SCHEMA)


def curve(cell, bits):
    """Hilbert index by walking the curve's definition on integers."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str((v >> j) & 1) for j in range(bits - 1, -1, -1) for v in x), 2)


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2)])
def test_hilbert_is_a_walk_over_the_grid(spark, n, bits):
    grid = spark.range((1 << bits) ** n).select(*[(F.floor(F.col("id") / (1 << bits) ** i) % (1 << bits)).cast("long").alias(f"a{i}") for i in range(n)])
    axes = [F.col(f"a{i}") for i in range(n)]
    rows = grid.select(*axes, sharding.hilbert_index(axes, bits).alias("h")).collect()
    walk = sorted(rows, key=lambda r: r.h)
    assert [r.h for r in walk] == list(range(len(rows)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(walk, walk[1:], strict=False))
    assert all(curve(r[:n], bits) == r.h for r in rows)


def test_shards_are_even_and_gapless(spark):
    rows = [(k % 60, None if k % 17 == 0 else "wörd " * (k % 7), ["en", None][k % 2], f"s{k % 3}" if k % 5 else None) for k in range(97)]
    out = sharding.hilbert_shards(docs(spark, rows), shards=10).collect()
    assert len(out) == 97
    counts = [sum(r.shard == s for r in out) for s in range(10)]
    assert max(counts) - min(counts) <= 1
    for s in range(10):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert sharding.hilbert_shards(docs(spark, [])).count() == 0


def plain_shards(rows, shards, bits=8):
    """``shard, slot`` of rows ``doc_id, text, lang, source``, sorted by curve, size, checksum, id, source, language."""
    import math
    import zlib

    raw = [(t or "").encode() for _, t, _, _ in rows]
    size = [len(x) + 16 for x in raw]
    low, high = math.log2(min(size)), math.log2(max(size))
    smaller = lambda values, v: sum((x or "") < (v or "") for x in values) * (1 << bits) // len(rows)
    sources, langs = [r[3] for r in rows], [r[2] for r in rows]
    none_first = lambda x: (x is not None, x if x is not None else 0)
    keys = []
    for (doc_id, _, lang, source), x, n in zip(rows, raw, size, strict=True):
        cell = min((1 << bits) - 1, math.floor((math.log2(n) - low) / (high - low) * (1 << bits))) if high > low else 0
        at = curve([smaller(sources, source), smaller(langs, lang), cell], bits)
        keys.append((at, n, zlib.crc32(x), none_first(doc_id), (source is not None, source or ""), (lang is not None, lang or "")))
    base, more = divmod(len(rows), shards)
    places = [(s, k) for s in range(shards) for k in range(base + (s < more))]
    return [(k[3][1] if k[3][0] else None, k[1], k[2], *place) for k, place in zip(sorted(keys), places, strict=True)]


def none_low(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_shards_equal_a_plain_sort(spark):
    rows = [(k % 60 if k % 13 else None, None if k % 17 == 0 else "wörd " * (k % 7), ["en", None, "de"][k % 3], f"s{k % 3}" if k % 5 else None) for k in range(97)] + [(5, "w " * 300_000, "en", "s1")]
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.hilbert_shards(docs(spark, rows), shards=10).collect()]
    assert none_low(got) == none_low(plain_shards([(i, t, g, s) for i, t, g, s in rows], 10))


def test_sharding_query_equals_a_plain_sort(spark):
    from corvane.llm import common, queries

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text", "lang", "source").collect()]
    out = queries.op7_sharding(spark, sf).collect()
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    assert none_low([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out]) == none_low(plain_shards(rows, 40))


def test_every_row_keeps_its_columns(spark, tmp_path):
    rows = [(1, "a", "en", "x")] * 3 + [(1, None, None, None), (2, "", "en", None)]
    d = docs(spark, rows).withColumns({"text_crc32": F.lit("big"), "shard": F.lit("small"), "Slot": F.lit(7), "_key": F.lit(8), "curve": F.lit(9), "_metadata": F.lit(1)})
    both = sharding.sharded(d, shards=2)
    assert both.columns == [*d.columns, "shard_", "slot_"]
    assert {(r.shard_, r.slot_) for r in both.collect()} == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)}
    assert sorted(both.drop("shard_", "slot_").collect(), key=str) == sorted(d.collect(), key=str)
    d.drop("_metadata").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    both = sharding.sharded(d, shards=2)
    assert sorted(both.drop("shard_", "slot_").collect(), key=str) == sorted(d.collect(), key=str)


def water(sizes):
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, out = set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in sizes if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_its_targets(spark):
    rows = [(k, "w " * (k % 9), "en", None if k % 11 == 0 else "ab"[k % 8 == 1] if k % 50 else "tiny") for k in range(3000)]
    out = mixing.fair_mix(docs(spark, rows)).collect()
    assert len(out) == 3000
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(want[s], abs=20)
    again = {(r.doc_id, r.taken) for r in mixing.fair_mix(docs(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_targets_of_many_sources(spark):
    """Sources as many as hosts: dealt by ranges, the same targets."""
    sizes = {f"h{k:04d}": 1 + (k * 37) % 101 for k in range(700)} | {None: 40_000}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    want = water(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_a_very_long_text_counts_whole(spark):
    out = {r.doc_id: r for r in mixing.fair_mix(docs(spark, [(1, "w " * 400_000, "en", "a"), (2, "w", "en", "b")])).collect()}
    assert out[1].size == 400_000 and out[2].target == 3 and out[2].taken == 3


def test_mix_of_nothing(spark):
    assert mixing.fair_mix(docs(spark, [])).count() == 0
    only_empty = mixing.fair_mix(docs(spark, [(1, None, None, None), (2, " ", "en", "a")])).collect()
    assert [r.taken for r in only_empty] == [0, 0]
