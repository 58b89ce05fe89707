"""The pipeline's stages on rows with repeated ids and without ids."""

import random
import re
from collections import Counter

import corpus_pipeline
from corvane.llm import mixing
from corvane.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "house", "river", "and", "stone", "hill", "red"]) + str(rng.randint(0, 9)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_one_row_of_each_class_stays_whatever_ids_repeat(spark, tmp_path):
    run = lambda rows: pairs(STAGES["near_duplicates"](spark, frame(spark, rows), str(tmp_path)))
    for seed in range(2):  # whichever of the two texts has the lesser hash
        clean, other = text(seed), text(100 + seed)
        rows = [(5, clean), (3, other), (5, other + " more")]
        assert run(rows) == sorted([(5, clean), (3, other)], key=str)
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (8, text(1)), (None, text(3)), (7, text(4)), (7, text(4)), (7, text(5)), (None, ""), (None, "")]
    want = [(8, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (None, ""), (None, "")]
    assert run(rows) == sorted(want, key=str)


def test_contaminated_rows_go_and_others_with_their_id_stay(spark, tmp_path):
    item = text(777, 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, text(1) + " " + item), (None, text(2)), (4, text(3) + " " + item), (4, text(4)), (5, None)]
    assert pairs(STAGES["decontamination"](spark, frame(spark, rows), str(tmp_path))) == sorted([(None, text(2)), (4, text(4)), (5, None)], key=str)


def test_a_third_without_ids_goes_through_the_pipeline(spark, tmp_path):
    rows = [(None if k % 3 == 0 else k // 2, text(k)) for k in range(60)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(777, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert pairs(out) == sorted(rows, key=str)
    mixed = STAGES["mixing"](spark, materialize(frame(spark, rows), "rows"), str(tmp_path))
    assert mixed.columns == out.columns[:5] and pairs(mixed) == sorted(rows, key=str)


def test_intermediate_tables_go_with_the_run(spark, tmp_path):
    from pathlib import Path

    from corvane.llm.common import shared_dir

    frame(spark, [(k, text(k)) for k in range(20)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(777, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    before = held()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(held() - before) == 1 and out.count() == 20


def test_all_rows_without_ids_are_kept(spark, tmp_path):
    rows = [(None, text(k)) for k in range(12)]
    assert pairs(STAGES["language"](spark, frame(spark, rows), str(tmp_path))) == sorted(rows, key=str)


def test_extra_columns_are_carried_unchanged(spark, tmp_path):
    """Names that the stages or their operators use themselves."""
    names = ["score", "lang_pred", "size", "text_crc32", "shard", "slot", "_nth", "_key", "_copy", "_times", "class_id", "sig", "h1", "rid", "row_key", "Taken", "curve", "key", "_place"]
    rows = [(k, text(k)) for k in range(25)] + [(30, text(3)), (31, text(4) + " more")]
    docs = frame(spark, rows).selectExpr("*", *[f"concat('{n}:', doc_id) AS `{n}`" for n in names])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(777, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard_", "slot_"]
    got = out.collect()
    assert sorted({r.doc_id for r in got}) == list(range(25))
    assert all(r[n] == f"{n}:{r.doc_id}" for r in got for n in names)
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, read, str(tmp_path)).columns == docs.columns, name


def plain_pipeline_rows(spark, docs, sf_dir):
    """What the first three stages leave, judged one row at a time."""
    from corvane.llm import decontamination, language

    profiles = language.learn(docs)
    kept = {r.doc_id for r in language.identify(docs.select("doc_id", "text"), profiles).collect() if r.lang_pred != "und"}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j < k)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((root(j), root(k)))
                label[b] = a
    rows = [r for k, r in enumerate(rows) if root(k) == k]
    items = {w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in decontamination.windows(r.text)}
    sizes = {len(w) for w in items}
    out = []
    for doc_id, t in rows:
        w, hit = decontamination.words(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in items:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(doc_id)
    return out


def test_pipeline_equals_brute_force(spark):
    """On a whole small table: the filtering stages, then each row as often as the mix says, shards even."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_pipeline_rows(spark, docs, sf)
    got = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = materialize(stage(spark, got, sf), "stage")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want
    mix = {r.doc_id: r.taken // r.size for r in mixing.fair_mix(got).collect() if r.size}
    out = corpus_pipeline.run(spark, sf).select("doc_id", "shard", "slot").collect()
    assert Counter(r.doc_id for r in out) == Counter({k: n for k, n in mix.items() if n})
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in out} == {(s, k) for s, n in counts.items() for k in range(n)}
