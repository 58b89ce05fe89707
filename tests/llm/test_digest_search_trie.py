"""Exact deduplication, lexical search and the prefix trie against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import exact_dedup as xd
from corvane.llm import lexical_search as ls
from corvane.llm import prefix_trie as pt

DOCS = "doc_id long, text string, keep_id string, digest int"


def dedup_rows():
    texts = ["a", "b", "A", "a ", "", None, "long " * 20_000, "é", "é"]
    rows = [(k, texts[k % len(texts)]) for k in range(60)] + [(k, "hot") for k in range(100, 400)]
    return rows + [(7, "b"), (7, "b"), (None, "hot"), (None, "only without id"), (None, "only without id"), (-3, "é")]


def brute_dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str), {t: best[t] for t in groups}


@pytest.mark.parametrize("arrivals", [1, 2, 5])
def test_dedup_equals_brute_force(spark, arrivals):
    rows = dedup_rows()
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)
    got = xd.deduplicate(d, arrivals).collect()
    want, best = brute_dedup(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=str) == want
    kept = [(r.digest.hex(), r.doc_id) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted(((hashlib.sha256(t.encode()).hexdigest(), d) for t, d in best.items()), key=str)


def test_index_persists_and_admits_only_new_texts(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "x", "p", 1), (2, "y", "q", 2), (3, "x", "r", 3)], DOCS)
    index = xd.DigestIndex.create(spark, "bigint", path, 4)
    assert sorted(r.doc_id for r in index.admitted(first).collect()) == [2, 3]
    assert index.admitted(first).count() == 0  # the same batch again adds nothing
    again = xd.DigestIndex.open(spark, "bigint", path, 4)  # as a later session would
    later = spark.createDataFrame([(9, "y", "s", 4), (10, "z", "t", 5), (11, None, "u", 6), (12, "", "v", 7)], DOCS)
    rows = again.admitted(later).collect()
    assert sorted(tuple(r) for r in rows) == [(10, "z", "t", 5), (12, "", "v", 7)]
    assert sorted(r.keep_id for r in again.entries().collect()) == [2, 3, 10, 12]
    again.forget()
    assert not (tmp_path / "index").exists()


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    prints = xd.fingerprints(spark.createDataFrame([(k, str(k % 7), "x", 1) for k in range(50)], DOCS))
    index = xd.DigestIndex.create(spark, "bigint")
    index.add(xd.grouped(prints))
    plan = index.unseen(xd.grouped(prints))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_dedup_of_empty_tables(spark):
    assert xd.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


# lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top):
    words = [(d, Counter(terms(t))) for d, t in docs]
    words = [(d, c) for d, c in words if c]
    n, total = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(w for _, c in words for w in c)
    out = []
    for k, (item, text) in enumerate(items):
        scored = []
        for d, c in words:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(k, item, r, None if absent else d, -s) for r, (s, absent, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def search_rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "日本", "x1"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(k, draw(int(rng.integers(1, 120)))) for k in range(400)] + [(1000 + k, "w5 w6 W7, w5") for k in range(80)]
    docs += [(None, "w5 w6 w7 w5"), (None, None), (2000, ""), (2001, "!?"), (3, docs[3][1]), (2002, "w1 " * 30_000)]
    items = [(k, draw(int(rng.integers(1, 30)))) for k in range(25)] + [(25, "W5 w6!w7"), (25, "nowhere"), (None, "w299 w298"), (27, None), (28, ""), (29, "w0"), (30, "É x1 x1")]
    return docs, items


@pytest.mark.parametrize("top, shard, block", [(50, 400_000, 1 << 17), (50, 700, 1 << 17), (7, 2000, 40)])
def test_search_equals_brute_force(spark, top, shard, block):
    docs, items = search_rows()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, rank string").coalesce(1)
    got = ls.search(ls.build_index(d, shard), i, top, block).collect()
    assert sorted(((r.number, r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute_search(docs, items, top)


def test_walk_scores_few_documents_and_bounds_hold(spark):
    docs, items = search_rows()
    row = ls.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).toArrow().to_batches()[0]
    n_docs, n_terms = row.column(2)[0].as_py(), row.column(3)[0].as_py()
    view = ls.ShardView([row.column(k)[0] for k in (0, 1, 5, 6, 7, 8, 9)], n_docs, n_terms)
    for t in range(len(view.bounds) - 1):
        at = slice(view.bounds[t], view.bounds[t + 1])
        assert ls.impact(view.counts[at].astype(np.int64), view.factor[view.docs[at]]).max() <= view.maximum[t]
    names = row.column(4)[0].as_py()
    df = np.diff(view.bounds)
    scored = 0
    for _, text in items:
        held = np.array([names.index(w) for w in sorted({t.encode() for t in terms(text)}) if w in names], int)
        heap = ls.Heap(5)
        if len(held):
            weights = np.array([ls.weight(int(x), n_docs) for x in df[held]])
            ls.walk(view, held, weights, heap)
            scored += ls.walk(view, held, weights, heap)  # a second walk meets a full heap
    assert scored < 0.25 * len(items) * n_docs


def test_memory_of_a_task_does_not_grow_with_its_shards_or_items(spark):
    import gc
    import sys

    import pyarrow as pa
    import pyarrow.parquet as pq

    docs = spark.range(60).selectExpr("id AS doc_id", "concat('word', id, ' and words') AS text").coalesce(1)
    index = ls.build_index(docs, 9)
    for path in index.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        assert meta.num_rows == 20 and all(meta.row_group(k).num_rows == 1 for k in range(meta.num_row_groups))
    gc.disable()  # a shard must go without it
    try:
        word = b"".join([b"wo", b"rd"])
        held = sys.getrefcount(word)
        shard = ls._Shard()
        shard.add(1, [word, b"b"])
        shard.row(pa.int64())
        del shard
        assert sys.getrefcount(word) == held
    finally:
        gc.enable()
    items = [(k, "the same words") for k in range(10)]
    assert [len(b.rows) for b in ls._blocks(items, 1 << 17, 4)] == [4, 4, 2]


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([], "item_id string, text string")
    assert ls.search(ls.build_index(docs), items).count() == 0
    some = spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", "z")], "doc_id string, text string")
    assert ls.search(ls.build_index(some), items).count() == 0
    found = ls.search(ls.build_index(some), spark.createDataFrame([("i", "y")], "item_id string, text string")).collect()
    assert [(r.item_id, r.doc_id) for r in found] == [("i", "a")]


# prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    said = {c: [r[3:] for r in sorted(t)] for c, t in own.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, t in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = said.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n in nodes:
        worth = (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += worth
            leaves[n[:d]] += n not in kids
    return sorted(
        (min(m), len(n), -99 if not n else min(nodes[n[:-1]]), len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in nodes.items()
    )


def trie_rows():
    rng = np.random.default_rng(11)
    rows = []
    for c in [*range(-12, 160), 10**15 + 3]:
        for turn in range(int(rng.integers(1, 12))):
            # few different turns, so that conversations share prefixes
            text = ["", None, "ja", "nö " * 3, "x"][int(rng.integers(0, 5))] if turn > 1 else "start"
            rows.append((c, turn if turn % 7 != 3 else None, ["user", None, "assistant"][turn % 3], text))
    rows += [(200, k, "user", f"t{k % 3}") for k in range(300)] + [(203, k, "user", f"t{k % 3}") for k in range(310)] + [(201, 0, "user", "a"), (201, 0, "user", "b"), (201, 0, "user", "a")]
    rows += [(c, k, "user", "same") for c in range(1000, 1400) for k in range(2)] + [(None, 0, "user", "nobody's")]
    return [rows[k] for k in rng.permutation(len(rows))]


def found_nodes(df):
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("long", [pt.LONG, 40])
def test_trie_equals_brute_force_whatever_counts_as_long(spark, long):
    rows = trie_rows()
    c = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(4)
    assert found_nodes(pt.build(c, long)) == brute_trie(rows)


def test_packs_of_ends_join_on(spark, monkeypatch):
    monkeypatch.setattr(pt, "PACK", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 100)]
    assert found_nodes(pt.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute_trie(rows)


def test_lanes_are_the_same_in_python_and_sql(spark):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(5)]
    d = spark.createDataFrame([(k + 1, bytearray(x)) for k, x in enumerate(digests)], "depth long, digest binary")
    from pyspark.sql import functions as F

    rows = d.select("depth", *[c.alias(n) for n, c in pt.lane_columns(F.col("digest"), F.col("depth")).items()]).orderBy("depth").collect()
    assert [list(r[1:]) for r in rows] == pt.lanes(digests).tolist()


def test_trie_of_an_empty_table(spark):
    assert pt.build(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
