"""Personal data, quality rules, classifier and page text against plain versions."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import html_text, layouts, pii, quality_classifier, quality_rules


def plain_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="19.@a-+ (25é", max_size=60))
def test_base_spans(text):
    assert [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE] == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000):
        pii.find_spans(text)


def test_checksums_confirm_and_context_raises():
    assert [s.kind for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32 ok")][0] == "iban"
    assert not [s for s in pii.find_spans("GB82 WEST 1234 5698 7654 33") if s.kind == "iban"]
    assert [s.kind for s in pii.find_spans("ssn 123-45-6789")] == ["ssn"]
    assert pii.find_spans("id 123-45-6789") == []
    assert pii.redact("mail a.b@c.de now", pii.find_spans("mail a.b@c.de now")) == "mail [EMAIL] now"


def test_pii_table(spark):
    d = spark.createDataFrame([(1, "x@y.zz", "c"), (1, "x@y.zz", "c"), (None, None, None), (2, "", "")], "doc_id long, text string, spans string")
    rows = sorted((r.doc_id or 0, len(r.spans), r.redacted) for r in pii.detect(d, with_text=True).collect())
    assert rows == [(0, 0, ""), (1, 1, "[EMAIL]"), (1, 1, "[EMAIL]"), (2, 0, "")]
    assert pii.detect(d.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_pii_query_equals_plain_search(spark, sf):
    import hashlib

    from corvane.llm import common, queries

    sf = f"/root/testdata/{sf}"
    got = {r.doc_id: r for r in queries.op3_pii(spark, sf).collect()}
    texts = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        r, want = got[doc_id], plain_spans(text or "")
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE] == joined
        assert r.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in pii.find_spans(text))


def plain_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hit = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rule_counts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b ", "é#", "\n", " ", "\t", "c|", "\x0b", " "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += [None, "", " \n ", "a b", "a b c", "x y z " * 40, "word " * 5000, "l\nl\n l\n"]
    d = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    rows = {r.doc_id: r for r in quality_rules.apply_rules(d).collect()}
    for k, t in enumerate(texts):
        r, want = rows[k], plain_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (k, t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(d.limit(0)).count() == 0


def test_windows_that_share_a_hash_are_sorted_by_their_words(spark):
    """The exact way that stands in where hashes collide."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(3, 40))) for _ in range(80)] + ["x y z", "a a a a a"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", F.split("t", " "))
    for t, places in d.select("t", quality_rules._repeated(F.col("w"))).collect():
        assert len({p + j for p in places for j in range(3)}) == plain_rules(t)[4]


def test_classifier_learns_from_labels_only(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["the", "house", "river", "stone", "of", "light"], 60))
    bad = lambda: " ".join(x + "###" for x in rng.choice(["win", "cash", "now"], 60))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)]
    d = spark.createDataFrame([*[(i, t, "c") for i, t in rows], (900, None, ""), (901, "", ""), (None, "the house", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    space = quality_classifier.learn(d, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(d, space).collect()}
    assert all((got[i] > 0.5) == (i % 3 > 0) for i, _ in rows)
    assert got[900] == got[901] == pytest.approx(space.prior, abs=1e-5)
    assert len(got) == 303
    assert {r.score for r in quality_classifier.score(d, quality_classifier.learn(d, labels.limit(0))).collect()} == {0.5}


def plain_score(space, c):
    """Every voter's cosine by itself, the nearest by (cosine, place)."""
    if not c.any():
        return space.prior
    v = space.vectors(c[None, :])[0].astype(float)
    sims = [sum(a * b for a, b in zip(v.tolist(), u.tolist(), strict=True)) for u in space.voters.astype(float)]
    near = sorted(range(len(sims)), key=lambda k: (-sims[k], k))[: quality_classifier.NEIGHBOURS]
    weight = [max(sims[k], 0) ** quality_classifier.POWER for k in near]
    return sum(w * space.labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight)


def test_blocked_cosines_equal_one_product():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 3, (60, quality_classifier.TERMS)).astype(np.float32)
    c[20:50] = c[7]  # ties across the last place
    space = quality_classifier._space(c, rng.integers(0, 2, 60).astype(float))
    together = space.scores(c)
    for k in range(60):
        assert space.scores(c[k : k + 1])[0] == together[k] == pytest.approx(plain_score(space, c[k]), abs=1e-9)
    assert len(set(together[20:50])) == 1


def test_the_sample_has_one_row_for_each_id(spark):
    d = spark.createDataFrame([(1, f"text number {k}") for k in range(500)] + [(2, "another"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, None), (None, 1)], "doc_id long, quality int")
    space = quality_classifier.learn(d, labels)
    assert space.labels.tolist() == [0.0, 1.0]


def test_classifier_query_equals_plain_votes(spark):
    """The registered query on a whole small table; accuracy on rows that nothing was learned from."""
    import zlib

    from corvane.llm import common, queries

    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    space = quality_classifier.learn(docs, labels)
    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    rows, truth = docs.select("doc_id", "text").collect(), {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == len(rows)
    right = []
    for k, r in enumerate(rows):
        held = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert got[r.doc_id].held_out == held and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        if held and r.doc_id in truth:
            right.append(got[r.doc_id].predicted == truth[r.doc_id])
        if k % 10 == 0:
            raw = np.frombuffer((r.text or "").encode(), np.uint8)
            assert got[r.doc_id].score == pytest.approx(plain_score(space, quality_classifier.counts(raw, np.array([0, len(raw)]))[0]), abs=2e-6)
    assert len(right) > 50 and sum(right) / len(right) > 0.97


def test_a_very_long_text_is_scored_whole(spark):
    good, bad = "the river of light ", "win### cash### now### "
    d = spark.createDataFrame([(k, good * 20 if k % 2 else bad * 20) for k in range(60)] + [(100, good * 2 + bad * 200_000), (101, bad * 2 + good * 200_000)], "doc_id long, text string")
    space = quality_classifier.learn(d, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality_classifier.score(d.filter("doc_id >= 100"), space).collect()}
    assert got[100] < 0.3 < 0.9 < got[101]


def test_blocks_of_a_page():
    page = "<title>t</title><nav><ul><li><a href='/x'>a &amp; b</a><li>c</ul></nav><article><h1>H&nbsp;x</h1><p><b>one<br>two<p>three\n four <!-- no --><script>var p='<p>'</script></article>tail<"
    got = html_text.blocks(page)
    assert [b.text for b in got] == ["a & b", "c", "H x", "one two", "three four", "tail<"]
    assert got[0].linked == 5 and "nav" in got[0].path and got[3].path == ("article", "p")
    assert html_text.blocks(None) == html_text.blocks("") == []


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = html_text.Labeller(rng, 5, 3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask, y = rng.normal(size=(4, 2, 5)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool), rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        p = model.forward(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for name, at in (("fw", (1, 2)), ("bu", (0, 5)), ("fc", (4,)), ("o", (3,)), ("oc", (0,))):
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-4
        up = loss()
        model.p[name][at] = keep - 1e-4
        down = loss()
        model.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_article_blocks_are_found(spark):
    model = html_text.trained()
    rng = np.random.default_rng(31)
    right = total = 0
    for _ in range(60):
        page, truth = layouts.compose(rng)
        found = html_text.blocks(page)
        for b, p in zip(found, model.label([found])[0], strict=True):
            right, total = right + ((p >= 0.5) == layouts.is_main(b.text, truth)), total + 1
    assert right / total > 0.97
    page = "<nav><a href=/>Home</a></nav><article><h1>Long title of it</h1><p>Some words of text here.</p></article><footer>&copy; x</footer>"
    d = spark.createDataFrame([(1, "u", page, "c"), (1, "u", page, "c"), (2, None, None, None), (3, "u", "", "")], "page_id long, url string, html string, text string")
    rows = [(r.page_id, r.text) for r in html_text.extract(d, model).orderBy("page_id").collect()]
    want = "Long title of it\nSome words of text here."
    assert rows == [(1, want), (1, want), (2, ""), (3, "")]
    assert html_text.extract(d.limit(0), model).select(F.length("text")).count() == 0
