"""Decontamination against brute force, language ID on held-out rows and odd input."""

import numpy as np
import pytest

from corvane.llm import decontamination as dc
from corvane.llm import language


def brute(text, items, slop=0):
    w, hit, ids = dc.words(text), set(), set()
    for item, t in items:
        for win in set(dc.windows(t)):
            for s in range(-slop - len(win), len(w) + slop):
                near = [[p for p in range(max(0, s + k - slop), min(len(w), s + k + slop + 1)) if w[p] == x] for k, x in enumerate(win)]
                if all(near):
                    hit |= {p for x in near for p in x}
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def key(rows):
    return sorted((str(r[0]), *r[1:3], tuple(r[3])) for r in rows)


def found(df):
    return key((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in df.collect())


@pytest.mark.parametrize("slop", [0, 1, 2, 3])
def test_hits_equal_brute_force_in_one_or_many_blocks(spark, slop):
    rng = np.random.default_rng(3)
    letters = list("abCDé") if slop == 0 else list("abcdefghijklmno")
    text = lambda n: " ".join(rng.choice(letters, n))
    items = [(k, text(int(rng.integers(1, 20)))) for k in range(12)] + [(50, ""), (51, None), (52, "!!"), (None, text(4)), (53, "a b c")]
    docs = [(k, text(int(rng.integers(0, 80)))) for k in range(60)] + [(5, items[3][1]), (5, items[3][1]), (None, None), (7, " ".join(t or "" for _, t in items)), (8, "x a"), (9, "b a c"), (10, "z z b c")]
    docs += [(20 + k, " ".join(rng.permutation((t or "").split()))) for k, (_, t) in enumerate(items)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_hit string").coalesce(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = key([(i, *brute(t, items, slop)) for i, t in docs])
    index = dc.build_index(d)
    for block in (1000, 4):
        assert found(dc.search(index, b, slop, block)) == want
    assert all(r.n_hit == 0 for r in dc.search(index, b.limit(0), slop).collect())
    assert dc.search(dc.build_index(d.limit(0)), b, slop).count() == 0


def test_proximity_allows_slop(spark):
    d = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x y z beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    near = {r.doc_id: r["items"] for r in dc.search(dc.build_index(d), b, slop=1).collect()}
    assert near == {1: ["9"], 2: []}


def test_absent_phrases_are_never_looked_at():
    here = {tuple(b"here %d" % k for k in range(5)): {"1"}}
    absent = {(b"never", *(b"w%d" % (j % 7) for j in range(k, k + 4))): {str(k)} for k in range(20_000)} | {(b"here 0", b"gone %d" % k): {"2"} for k in range(50)}
    p = dc.Phrases.of({**absent, **here})
    present = np.array([not w.startswith((b"never", b"gone")) for w in p.vocabulary])
    assert [p.items[k] for k in p.candidates(present)] == [("1",)]


def test_a_very_long_text_is_indexed_whole(spark):
    d = spark.createDataFrame([(1, "w " * 900_000 + "the needle is here"), (2, "the needle")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "the needle is here")], "item_id long, text string")
    assert found(dc.search(dc.build_index(d), b)) == key([(1, 900_004, 4, ["9"]), (2, 2, 0, [])])


TEXTS = {"aa": "the cat and the dog ran to the house ", "bb": "der hund und die katze laufen zum haus ", "cc": "le chat et le chien courent vers la maison "}


def test_language_profiles(spark):
    rows = [(k, TEXTS[lang] * (k % 4 + 1), lang, "clash") for k, lang in enumerate(list(TEXTS) * 20)]
    d = spark.createDataFrame([*rows, (900, None, "aa", ""), (901, "123 !!", None, ""), (902, "", "bb", ""), (None, "the dog", None, ""), (903, TEXTS["cc"] * 30_000, None, "")], "doc_id long, text string, lang string, score string")
    with pytest.raises(ValueError, match="called"):
        language.identify(d, {})
    out = language.identify(d, language.learn(d), results=("lang_pred", "sure"))
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "sure"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].sure <= 1 and got[i].score == "clash" for i, _, lang, _ in rows)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 3 + ["cc"]
    assert got[None].lang_pred == "aa"
    assert {r.lang_pred for r in language.identify(d.select("doc_id", "text"), {}).collect()} == {"und"}
    assert language.learn(d.limit(0)) == {}


def test_profiles_are_learned_from_a_bounded_sample(spark):
    """One row for each id, however many rows repeat it or its language has."""
    rows = [(k, TEXTS["aa"] + str(k), "aa") for k in range(4000)] + [(7, TEXTS["aa"], "aa")] * 2000 + [(k, TEXTS["bb"], "bb") for k in range(5000, 5009)] + [(None, "x", "aa")] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    n = {r["lang"]: r["n"] for r in language._sampled(d.filter("doc_id is not null"), 100).groupBy("lang").count().withColumnRenamed("count", "n").collect()}
    assert n == {"aa": 100, "bb": 9}


def plain_grams(text, most):
    counts = {}
    for w in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split():
        p = f" {w} "
        for g in [*w, *(p[k : k + 2] for k in range(len(p) - 1)), *(p[k : k + 3] for k in range(len(p) - 2))]:
            counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:most]


def test_prediction_equals_plain_out_of_place_distances(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    profiles = language.learn(docs)
    spelled = {lang: {"".join(chr(int(c) >> 21 * k & 0x1FFFFF) for k in (2, 1, 0) if int(c) >> 21 * k): i for i, c in enumerate(p)} for lang, p in profiles.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs.select("doc_id", "text"), profiles).collect()}
    for r in docs.collect():
        grams = plain_grams(r.text, language.LENGTH)
        far = {lang: sum(abs(p[g] - i) if g in p else language.LENGTH for i, g in enumerate(grams)) for lang, p in spelled.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert got[r.doc_id] == (best, round(1 - far[best] / (language.LENGTH * len(grams)), 6)) if grams else ("und", 0.0)


def test_pieces_do_not_change_a_profile(monkeypatch):
    text = "Größe und Länge, été où naïve — " * 40
    whole = language.ranked(text)
    monkeypatch.setattr(language, "PIECE", 17)
    assert (language.ranked(text) == whole).all()
