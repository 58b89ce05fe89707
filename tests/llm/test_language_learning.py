"""Learning of language profiles against a plain version."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corvane.llm import language

LETTERS = {"a": "abcdeéf ", "b": "aghijß k", "c": "almnÆop q"}


def folded(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    return f" {low} "


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def plain_ranked(text, length):
    s, n = folded(text), Counter()
    for k in range(1, len(s) - 1):
        if s[k] != " ":
            n.update([s[k], s[k - 1 : k + 1], s[k - 1 : k + 2], *([s[k : k + 2]] if s[k + 1] == " " else [])])
    return [g for g, _ in sorted(((code(x), c) for x, c in n.items()), key=lambda p: (-p[1], p[0]))][:length]


def plain_learn(rows, sample, length):
    hashed = lambda d: xxhash.xxh64_intdigest(int(d).to_bytes(8, "little", signed=True), seed=42)
    text_hash = lambda t: np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)))
    known = defaultdict(lambda: defaultdict(list))
    for d, lang, text in rows:
        if d is not None and lang is not None and text is not None and zlib.crc32(str(d).encode()) % 5:
            known[lang][d].append(text)
    out = {}
    for lang, ids in known.items():
        # by the hash's place, which is its remainder as a signed number
        chosen = sorted(ids, key=lambda d: (hashed(d) % (1 << 40), d))[:sample]
        weights = defaultdict(float)
        for d in chosen:
            for k, g in enumerate(plain_ranked(min(ids[d], key=text_hash), 4 * length)):
                weights[g] += 1 / (1 + k)
        out[lang] = [g for g, _ in sorted(((g, round(w, 6)) for g, w in weights.items()), key=lambda p: (-p[1], p[0]))][:length]
    return out


@pytest.mark.parametrize("sample, length", [(500, 300), (15, 40)])
def test_profiles_equal_a_plain_version(spark, sample, length):
    rng = np.random.default_rng(7)
    rows = [(int(k), lang, "".join(rng.choice(list(LETTERS[lang]), int(rng.integers(0, 90))))) for k, lang in enumerate(rng.choice(list("aaaaabc"), 260))]
    rows += [(3, "a", "another text of row three"), (5, "b", None), (None, "a", "nobody's"), (6, None, "no language"), (-4, "c", "Ǆ Straße 12 x"), (10**12, "b", "")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, score string").repartition(3)
    got = language.learn(d, sample, length)
    want = plain_learn(rows, sample, length)
    assert set(got) == set(want)
    for lang in want:
        assert list(got[lang]) == want[lang], lang
