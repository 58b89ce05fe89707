"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words, hashed to ``WORD_TERMS`` numbers, and the shapes of
its words (which kinds of characters they hold, whether they repeat the word
before). Logarithmic counts, weighted by inverse document frequency, are projected
on the leading singular vectors of a labelled sample. The sample's vectors, at most
``SAMPLE`` of ``RANK`` numbers (1 MB), travel with the task; every document's exact
cosines to all of them are computed in blocks, and the nearest ``NEIGHBOURS`` vote
with their similarity as weight.

Vectors are rounded to multiples of 1 / ``GRID``. Products of such numbers and their
sums are exact in single precision, so a cosine is the same in whatever block it is
computed, and equal cosines are equal: of those at the last place the voters that
come first (by id, as a string) vote.

One pass over the texts, no shuffle of texts. Learning takes the ids with the least
hashes among the labelled ones that are not held out, and one row of each, so it
costs the same at any size and whatever ids repeat. Edge cases: a text without a
word gets the share of label 1 in the sample; without a labelled row every score is
0.5; null labels and ids are not learned from; of several labels of an id the least
counts, of several texts the one with the least hash; repeated rows get equal
scores; a very long text is counted whole; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import vector
from corvane.llm.common import held_out

WORD_TERMS = 4096
SHAPES = 128
TERMS = WORD_TERMS + SHAPES
RANK = 64
NEIGHBOURS = 25
#: Bound on the labelled rows that the space and the voters come from.
SAMPLE = 4000
#: Similarities vote with this power, so that near voters outweigh the many that share common words.
POWER = 8
GRID = 2048
#: Documents in a block.
ROWS = 256

_FLAG = np.zeros(256, np.uint8)
_FLAG[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_FLAG[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_FLAG[[*b"0123456789"]] = 4
_FLAG[[*b"#*$%&|<>@=_/\\~^{}[]"]] = 8
_FLAG[[*b".,;:!?'\"()-+`"]] = 16
_FLAG[128:] = 32


def counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Term counts of each row."""
    n = len(at) - 1
    starts, _, rows, (h,) = vector.words(raw, at)
    if not len(starts):
        return np.zeros((n, TERMS), np.float32)
    row = np.repeat(np.arange(n), np.diff(rows))
    shape = np.bitwise_or.reduceat(_FLAG[raw], starts).astype(np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape |= np.where(again, 64, 0)
    term = np.concatenate([(h >> np.uint64(52)).astype(np.int64), WORD_TERMS + shape])
    return np.bincount(np.concatenate([row, row]) * TERMS + term, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


@dataclass(frozen=True)
class Space:
    idf: np.ndarray
    axes: np.ndarray  # terms x rank
    voters: np.ndarray  # sample x rank, unit length
    labels: np.ndarray
    prior: float

    def vectors(self, c: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(c.astype(np.float64)) * self.idf @ self.axes)

    def scores(self, c: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(c), 0.5)
        cosine = self.vectors(c) @ self.voters.T
        k = min(NEIGHBOURS, len(self.labels))
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        nearer, level = cosine > last, cosine == last
        votes = nearer | level & (np.cumsum(level, axis=1) <= k - nearer.sum(axis=1, keepdims=True))
        weight = np.where(votes, np.maximum(cosine, 0), 0).astype(np.float64) ** POWER
        vote = (weight * self.labels).sum(axis=1)
        total = weight.sum(axis=1)
        score = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)
        return np.where(c.any(axis=1), score, self.prior)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length on the grid."""
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return (np.round(unit * GRID) / GRID).astype(np.float32)


def _space(c: np.ndarray, labels: np.ndarray) -> Space:
    if not len(labels):
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = np.log1p(c) * idf
    rank = min(RANK, *x.shape)
    # truncated singular value decomposition by subspace iteration
    q = np.random.default_rng(5).normal(size=(TERMS, rank + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = np.ascontiguousarray((q @ vt.T)[:, :rank], dtype=np.float64)
    space = Space(idf.astype(np.float64), axes, np.zeros((0, rank), np.float32), labels, float(labels.mean()))
    return replace(space, voters=np.concatenate([space.vectors(c[k : k + ROWS]) for k in range(0, len(c), ROWS)]))


def _steps(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of at most ``ROWS`` rows of a bounded size; a longer row is a block of its own."""
    for a, b in vector.row_groups(at, vector.PIECE // 2):
        for i in range(a, b, ROWS):
            yield i, min(b, i + ROWS)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = rows.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `sample` narrow rows at most
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text").isNull())).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = vector.utf8(batch.column(2))
            for a, b in _steps(at):
                c = counts(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.string()), batch.column(1).slice(a, b - a), pa.array([x.astype(np.uint32).tobytes() for x in c])], ["doc_id", "quality", "counts"])

    got = sorted((r["doc_id"], r["quality"], bytes(r["counts"])) for r in texts.mapInArrow(count, "doc_id string, quality int, counts binary").toLocalIterator())
    c = np.array([np.frombuffer(x[2], np.uint32) for x in got], np.float32).reshape(-1, TERMS)
    return _space(c, np.array([x[1] for x in got], np.float64))


def score(docs: DataFrame, space: Space) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            raw, at = vector.utf8(batch.column(1))
            for a, b in _steps(at):
                s = own.scores(counts(raw[at[a] : at[b]], at[a : b + 1] - at[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.round(np.clip(s, 0, 1), 6))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")
