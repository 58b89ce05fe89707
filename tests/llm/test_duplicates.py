"""Near duplicates, substring dedup and the pipeline against brute force."""

import hashlib
import random
import re

import corpus_pipeline
from corvane.llm import components, near_duplicates, substring_dedup


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sample(seed=6, n=90):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 160))] for _ in range(12)]
    out = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        if rng.random() < 0.2:
            w = w[: len(w) // 2] + list(rng.choice(base))[:70]
        out.append((k * 3 % (n * 2), " ".join(w) if rng.random() < 0.8 else "\n ".join(w)))
    return [*out, (500, None), (501, ""), (502, "one two"), (503, "one two"), (504, " "), (505, "one"), out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or ""), "clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, class_id string")


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows, strict=True):
        least[x] = min(least.get(x, i), i)
    return sorted((i, least[x], n) for (i, _), x, n in zip(rows, label, links, strict=True))


def test_join_equals_brute_force(spark, monkeypatch):
    rows = sample()
    want = brute_classes(rows)
    for small, block in ((256, 1024), (4, 8)):
        monkeypatch.setattr(near_duplicates, "SMALL", small)
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        got = near_duplicates.join(frame(spark, rows)).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert near_duplicates.join(frame(spark, rows).limit(0)).count() == 0
    assert near_duplicates.join(frame(spark, [(None, "a b c d e f"), (None, None)])).count() == 2


def test_no_link_is_lost_at_low_thresholds(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(90)] for _ in range(8)]
    rows = []
    for k in range(120):
        w = list(rng.choice(base))
        at = rng.randrange(70)
        w[at : at + rng.choice([0, 5, 10, 20])] = [f"x{rng.randint(0, 999)}" for _ in range(rng.choice([0, 5, 15, 30]))]
        rows.append((k, " ".join(w)))
    for threshold in (0.5, 0.3):
        got = near_duplicates.join(frame(spark, rows), threshold=threshold).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows, threshold)
    assert sum(n for _, _, n in brute_classes(rows, 0.3)) > sum(n for _, _, n in brute_classes(rows, 0.5)) > 100


def test_runs_and_places_follow_from_threshold_and_recall():
    for threshold in (0.2, 0.3, 0.5, 0.8, 0.95):
        runs = near_duplicates.runs_for(0.999, threshold)
        once = threshold * (1 - (1 - threshold) ** near_duplicates.BRANCHES) ** near_duplicates.DEPTH
        assert (1 - once) ** runs <= 0.0005 < (1 - once) ** (runs - 1)
        places = max(runs, near_duplicates.SIGNATURE)
        k = near_duplicates.agreeing_for(0.999, threshold, places)
        draws = [sum(random.Random(s * 7 + j).random() < threshold for j in range(places)) for s in range(2000)]
        assert sum(d < k for d in draws) <= 8
    assert near_duplicates.runs_for(0.9, 1.0) == 1 and near_duplicates.agreeing_for(0.9, 1.0, 48) == 48


def test_rows_without_ids_cost_no_more_than_others(spark):
    """Joins by row numbers make one row of each; by ids there would be millions."""
    text = lambda k: " ".join(random.Random(k).choices(["a", "b", "c", "d", "e"], k=60))
    rows = [(None, text(k % 2500) + (" tail" if k % 2 else "")) for k in range(10_000)] + [(7, text(3))] * 500
    got = near_duplicates.join(frame(spark, rows)).collect()
    assert len(got) == 10_500
    assert {r.class_id for r in got if r.doc_id is None} == {None, 7}
    assert all(r.n_links >= 3 for r in got)


def test_large_buckets_are_split_by_bytes(spark, monkeypatch):
    rows = sample(9, 40)
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(near_duplicates, "SMALL", 4)
    got = near_duplicates.join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows)


def test_very_long_texts_are_joined_whole(spark):
    long = " ".join(str(random.Random(5).randint(0, 9**9) + k) for k in range(120_000))
    rows = [(1, long), (2, "first " + long), (3, long[: len(long) // 2])]
    got = near_duplicates.join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def brute_dedup(rows, size):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            win = tuple(w[k : k + size])
            least[win] = min(least.get(win, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - size + 1) if least[tuple(w[k : k + size])] < i for j in range(size)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def test_dedup_equals_brute_force(spark):
    rows = sample(8)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, rows)).collect()]
    assert sorted(got) == brute_dedup(rows, 50)
    long = " ".join(random.Random(3).choice("abcdefgh") + str(k % 9000) for k in range(60_000))
    rows = [(1, long), (2, "x y z " + long[1000:-1000] + " end"), (1, long), (0, "short")]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, rows)).collect()]
    assert sorted(got) == brute_dedup(rows, 50)
    small = [(k, " ".join(random.Random(k).choice("abc") for _ in range(30))) for k in range(25)]
    got = [tuple(r) for r in substring_dedup.dedup(frame(spark, small), window=6, gram=2).collect()]
    assert sorted(got) == brute_dedup(small, 6)
    kept = {r.doc_id: r.kept for r in substring_dedup.dedup(frame(spark, [(1, "a\tb é"), (2, None)]), with_text=True).collect()}
    assert kept == {1: "a b é", 2: ""}
    assert substring_dedup.dedup(frame(spark, []), with_text=False).count() == 0
    nothing = substring_dedup.dedup(frame(spark, [(None, rows[0][1]), (None, rows[0][1])])).collect()
    assert [r.n_removed for r in nothing] == [0, 0]


def test_pipeline(spark, tmp_path):
    text = lambda s, n=80: " ".join(random.Random(s).choice(["the", "of", "house", "river", "and", "stone", "hill", "red"]) + str(random.Random(s * 1000 + k).randint(0, 9)) for k in range(n))
    rows = [(k, text(k)) for k in range(40)] + [(100, text(3)), (101, text(4)), (102, "12 34"), (103, None), (104, text(200) + " " + text(777, 20)), (None, text(5)), (7, text(7))]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(777, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(40))
    assert sorted({r.shard for r in out}) == list(range(len(out)) if len(out) < 40 else range(40))
    name, stage = corpus_pipeline.STAGES[1]
    assert name == "near_duplicates"
    assert sorted(r.doc_id for r in stage(spark, docs.filter("text is not null"), str(tmp_path)).collect()) == [*range(40), 102, 104]
    left = corpus_pipeline.STAGES[2][1](spark, docs.filter("doc_id is not null"), str(tmp_path)).collect()
    assert 104 not in {r.doc_id for r in left} and len(left) == len(rows) - 2
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
