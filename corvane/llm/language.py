"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, words padded
with a space) of a language in order of frequency. A document's own list is
compared to each profile by the out-of-place distance: the sum over its n-grams
of how far their ranks differ, with a fixed penalty for those not in the profile.

Profiles are learned from a sample of at most ``SAMPLE`` rows per language, those
with the least hash of their id, one row for each id. Rows are counted first, and
only a share of each language that leaves some ``SPARE`` times the sample is ranked,
so that a frequent language costs no task more than a rare one. There are at most
``LANGUAGES`` of them, which is checked. The profiles are a few kilobytes and travel
with the task. Prediction is one pass without a shuffle.

Edge cases: null text or text without a letter gives ``und`` with score 0;
equal distances go to the language that sorts first; if no row can be learned
from, every row is ``und``; rows without an id are not learned from; of repeated
ids the row whose text has the least hash is; repeated rows give equal results; a
very long text is read whole, in pieces; an empty table gives no rows; extra
columns are carried along, and one that is called as a result column is an error
(name the result columns otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import fresh, held_out

UNKNOWN = "und"
LENGTH = 300
#: Bound on the rows that a profile is learned from, for each language.
SAMPLE = 500
#: How many times the sample is ranked where a language has more rows.
SPARE = 4
#: Bound on the number of languages.
LANGUAGES = 1000
#: Letters whose n-grams are counted at once; longer texts are counted in pieces.
PIECE = 1 << 18

_tables: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    if not _tables:
        table = np.full(0x110000, 32, np.int64)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def _grams(letters: np.ndarray) -> np.ndarray:
    """Codes of the n-grams in folded text: 21 bits a letter; none spans a space in its middle."""
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    solid = b != 32
    one = b[solid]
    two = (a[solid] << 21) | b[solid]
    ends = solid & (c == 32)
    last = (b[ends] << 21) | 32
    three = (a[solid] << 42) | (b[solid] << 21) | c[solid]
    return np.concatenate([one, two, last, three])


def ranked(text: str | None, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first; ties by code."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for first in range(0, len(points), PIECE):
        at = max(0, first - 1)
        end = min(len(points), first + PIECE)
        piece = _folding()[points[at : min(len(points), end + 1)]]
        if at == 0:
            piece = np.concatenate([[32], piece])
        if end == len(points):
            piece = np.concatenate([piece, [32]])
        found, n = np.unique(_grams(piece), return_counts=True)
        if len(codes):
            every, where = np.unique(np.concatenate([codes, found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
            codes = every
        else:
            codes, counts = found, n
    return codes[np.argsort(-counts, kind="stable")[:length]]


def distances(grams: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], length: int = LENGTH) -> np.ndarray:
    """Out-of-place distance to each profile, as a share of the greatest one."""
    own = np.arange(len(grams))
    out = np.empty(len(profiles))
    for k, (codes, ranks) in enumerate(profiles):
        at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
        there = codes[at] == grams
        out[k] = np.where(there, np.abs(ranks[at] - own), length).sum()
    return out / (length * max(1, len(grams)))


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """``lang, text`` of at most ``sample`` rows of each language, those with the least hashes of their ids."""
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(seen) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    steps = 1 << 40
    place = F.pmod(F.xxhash64("doc_id"), F.lit(steps))
    share = F.lit(steps)
    for r in seen:
        if r["n"] > SPARE * sample:
            share = F.when(F.col("lang") == r["lang"], steps * SPARE * sample // r["n"]).otherwise(share)
    ids = rows.withColumn("_place", place).filter(F.col("_place") < share).groupBy("lang", "doc_id", "_place").agg(F.count(F.lit(1)))
    order = Window.partitionBy("lang").orderBy("_place", "doc_id")
    ids = ids.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample).select("lang", "doc_id")
    # at most `sample` narrow rows for each of at most LANGUAGES languages
    chosen = rows.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi")
    return chosen.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")


def learn(docs: DataFrame, sample: int = SAMPLE, length: int = LENGTH) -> dict[str, np.ndarray]:
    """A profile for each language, from rows that are not held out and have a language."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = _sampled(rows, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, text in zip(langs, texts, strict=True):
                grams = ranked(text, 4 * length)
                weight = 1.0 / (1 + np.arange(len(grams)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(weight)], ["lang", "gram", "weight"])

    sums = chosen.mapInArrow(count, "lang string, gram bigint, weight double").groupBy("lang", "gram").agg(F.round(F.sum("weight"), 6).alias("w"))
    best = sums.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("w"), "gram"))).filter(F.col("_r") <= length)
    found: dict[str, list] = {}
    for r in best.orderBy("lang", "_r").collect():  # `length` rows for each language
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in sorted(found.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], length: int = LENGTH, results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` (all columns) with the language and its score in columns ``results``.

    The score is 1 less the distance to the nearest profile, as a share of the greatest distance.
    """
    if any(fresh(docs.columns, r) != r for r in results):
        raise ValueError(f"docs has a column that is called as one of {results}")
    names = list(profiles)
    sorted_profiles = []
    for grams in profiles.values():
        order = np.argsort(grams)
        sorted_profiles.append((grams[order], order))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at):
                grams = ranked(text.as_py(), length)
                if not len(grams) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                far = distances(grams, sorted_profiles, length)
                k = int(far.argmin())
                langs.append(names[k])
                scores.append(round(float(1 - far[k]), 6))
            cols = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *results])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{results[0]}` string, `{results[1]}` double")
