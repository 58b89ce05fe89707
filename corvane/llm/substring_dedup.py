"""Substring dedup: removes every 50-word window that starts in a document with a smaller id.

Stage 1, count-min prefilter. Each window is represented by its anchor, the
``GRAM``-word run inside it with the least hash: a function of the window's words
alone, so equal windows have equal anchors, and some twenty neighbouring windows
share one. Every task counts its documents' distinct anchors in a partial sketch
(kept as lists of touched cells); the partial sketches are added cell by cell.
The sketch never counts too low, so a window whose anchor it counts once occurs
in one document only: nothing that repeats is lost.

Stage 2, exact. Neighbouring windows with one anchor form a run. Runs whose anchor
is estimated to repeat are grouped by the 128-bit hash of their words: a run that a
smaller document has too is removed whole. Only where one anchor stands in
different runs are single windows grouped, and only those of each run's first
document, which stands for its copies. So copies, however many, cost one row per
run, and a hot passage is pre-aggregated before it is shuffled.

The sketch is broadcast; its width follows the input up to ``MOST_CELLS`` cells a
row (48 MB in all), which the anchors of some 20 GB of text fill to the intended
load. Beyond, it filters less and less, until every run goes to the exact stage: a
shuffle of about 40 bytes for each 20 words. Results stay the same.

Edge cases: null text has no words; a text under 50 words has no window and stays;
equal ids do not remove from one another (repeated rows, and texts that repeat
within themselves, keep their words); a row without an id neither removes nor loses
words; a very long text is read whole; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import vector
from corvane.llm.common import materialize

WINDOW = 50
GRAM = 10
DEPTH = 3
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 27
CHUNK = 1 << 20
CELLS_PER_ANCHOR = 8
FLUSH = 1 << 21


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(h: np.ndarray, rows: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, over the words of all rows at once:
    row, first window, last window (as word numbers) and the anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.astype(np.uint64)
    roll = vector.Rolling(h)
    at = np.arange(len(h) - gram + 1)
    grams = roll.of(at, at + gram)
    mask = np.uint64((1 << 24) - 1)
    least = _sliding_min((grams & ~mask) | (at.astype(np.uint64) & mask), window - gram + 1)
    start = np.arange(len(least))
    anchor = start + (((least & mask).astype(np.int64) - start) & int(mask))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(start)]
    valid = start + window <= rows[row + 1]
    start, anchor, row = start[valid], anchor[valid], row[valid]
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[first], start[first], start[last], grams[anchor[first]]


def _cells(anchors: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for k in range(DEPTH):
        yield k * width + (vector.mix(anchors + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & np.uint64(width - 1)).astype(np.int64)


def _partial(anchors: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """A partial sketch: of each chunk the cells counted once and those counted more often."""
    every = np.concatenate([np.zeros(0, np.uint64), *anchors])
    for cells in _cells(every, width):
        cell, n = np.unique(cells, return_counts=True)
        chunk = cell // CHUNK
        at = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(cell))
        local, often = (cell % CHUNK).astype(np.uint32), n > 1
        out = [(int(chunk[a]), local[a:b][~often[a:b]].tobytes(), local[a:b][often[a:b]].tobytes()) for a, b in zip(at, at[1:], strict=False)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["chunk", "once", "often"])


def sketch(docs: DataFrame, window: int, gram: int) -> tuple[np.ndarray, int]:
    """Bits of the merged sketch's cells that count two or more, and the cells in a row."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    guess = size * 2 // (6 * (window - gram + 2))
    width = LEAST_CELLS
    while width < min(MOST_CELLS, CELLS_PER_ANCHOR * guess):
        width *= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            raw, at = vector.utf8(batch.column(0))
            for a, b in vector.row_groups(at):
                _, _, rows, (h,) = vector.words(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                row, _, _, anchor = runs(h, rows, window, gram)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                held.append(anchor[new])
                n += len(held[-1])
                if n >= FLUSH:
                    yield from _partial(held, width)
                    held, n = [], 0
        yield from _partial(held, width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, once, often in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = counts.setdefault(chunk, np.zeros(CHUNK, np.uint8))
                have[np.frombuffer(often, np.uint32)] = 2
                own = np.frombuffer(once, np.uint32)
                have[own] = np.minimum(have[own] + 1, 2)
        for chunk, have in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([np.packbits(have > 1).tobytes()])], ["chunk", "bits"])

    parts = docs.select("text").mapInArrow(count, "chunk bigint, once binary, often binary")
    chunks = max(1, DEPTH * width // CHUNK)
    merged = parts.repartition(min(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "chunk").mapInArrow(merge, "chunk bigint, bits binary")
    bits = np.zeros(DEPTH * width // 8, np.uint8)
    for r in merged.toLocalIterator():  # DEPTH * MOST_CELLS / 8 bytes at most
        bits[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits, width


def estimated_repeated(anchors: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for cells in _cells(anchors, width):
        out &= (bits[cells >> 3] >> (7 - (cells & 7))) & 1 == 1
    return out


RUN = "array<struct<anchor:bigint,h1:bigint,h2:bigint,first:int,last:int>>"
_RUN = pa.list_(pa.struct([("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row; ``with_text`` adds ``kept``, the
    words that stay, joined by one space."""
    spark = docs.sparkSession
    docs = docs.select("text", "doc_id")
    bits, width = sketch(docs, window, gram)
    sent = spark.sparkContext.broadcast(bits)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            raw, at = vector.utf8(batch.column(0))
            for a, b in vector.row_groups(at):
                part, edges = raw[at[a] : at[b]], at[a : b + 1] - at[a]
                _, _, rows, (h, g) = vector.words(part, edges, 2)
                row, first, last, anchor = runs(h, rows, window, gram)
                keep = estimated_repeated(anchor, table, width)
                row, first, last, anchor = row[keep], first[keep], last[keep], anchor[keep]
                h1 = vector.Rolling(h).of(first, last + window).view(np.int64)
                h2 = vector.Rolling(g, 1).of(first, last + window).view(np.int64)
                own = np.searchsorted(row, np.arange(b - a + 1))
                offsets = pa.array(own, pa.int32())
                fields = [pa.array(anchor.view(np.int64)), pa.array(h1), pa.array(h2), pa.array((first - rows[row]).astype(np.int32)), pa.array((last - rows[row]).astype(np.int32))]
                found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, [f.name for f in _RUN.value_type]))
                data = part.tobytes()
                sha, text, kept = [], [], []
                for k in range(b - a):
                    body = data[edges[k] : edges[k + 1]]
                    done = own[k] == own[k + 1]
                    words = body.split() if done else None
                    sha.append(_digest(words) if done else None)
                    kept.append(b" ".join(words).decode() if done and with_text else None)
                    text.append(None if done else body)
                cols = [batch.column(1).slice(a, b - a), pa.array(np.diff(rows).astype(np.int64)), pa.array(sha, pa.string()), pa.array(text, pa.binary()), found.cast(_RUN), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "sha", "body", "runs", "kept"])

    rows = docs.mapInArrow(probe, f"doc_id {id_type}, n_words bigint, sha string, body binary, runs {RUN}, kept string")
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "windows")
    open_ = rows.filter(F.col("sha").isNull())
    every = open_.select("rid", "doc_id", F.explode("runs").alias("r")).select("rid", "doc_id", "r.*")

    # Which runs a smaller document has too; which anchors stand in different runs.
    spans = every.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    varied = spans.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("varied"), (F.sum("n") > 1).alias("again"))
    judged = spans.join(varied.filter("again"), "anchor").select("anchor", "h1", "h2", "least", "varied")
    judged = every.join(judged, ["anchor", "h1", "h2"])
    work = judged.select("rid", "doc_id", "first", "last", (F.col("doc_id") > F.col("least")).alias("gone"), "varied").filter("gone or varied")
    work = materialize(work, "runs")
    single = work.filter("not gone and varied").groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = vector.utf8(batch.column(0).cast(pa.string()))
            for k in range(batch.num_rows):
                body = raw[at[k] : at[k + 1]]
                _, _, _, (h, g) = vector.words(body, np.array([0, len(body)]), 2)
                place = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in batch.column(3)[k].as_py()]))
                h1, h2 = (vector.Rolling(x, n).of(place, place + window).view(np.int64) for n, x in enumerate((h, g)))
                many = lambda c: pa.array([c[k].as_py()] * len(place), c.type)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([many(batch.column(1)), many(batch.column(2)), pa.array(place.astype(np.int32)), pa.array(h1), pa.array(h2)], ["rid", "doc_id", "first", "w1", "w2"])

    lone = open_.join(single, "rid").select("body", "rid", "doc_id", "spans").mapInArrow(split, f"rid bigint, doc_id {id_type}, first int, w1 bigint, w2 bigint")
    lone = materialize(lone, "single-windows")
    least = lone.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least").drop("most")
    hits = lone.join(least, ["w1", "w2"]).filter("doc_id > least").select("rid", "first", F.col("first").alias("last"))
    gone = work.filter("gone").select("rid", "first", "last").unionByName(hits)
    gone = gone.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words, removed, sha, kept = [], [], [], [], []
            for doc_id, body, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = body.split()
                edge = np.zeros(len(words) + 1, np.int64)
                if spans:
                    np.add.at(edge, [s["first"] for s in spans], 1)
                    np.add.at(edge, [s["last"] + window for s in spans], -1)
                out = np.cumsum(edge)[:-1] > 0
                left = [w for w, gone in zip(words, out, strict=True) if not gone]
                ids.append(doc_id)
                n_words.append(len(words))
                removed.append(int(out.sum()))
                sha.append(_digest(left))
                kept.append(b" ".join(left).decode() if with_text else None)
            cols = [pa.array(ids, batch.column(0).type), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    changed = open_.join(gone, "rid", "left").select("doc_id", "body", "spans").mapInArrow(cut, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    same = rows.filter(F.col("sha").isNotNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), "kept")
    result = same.unionByName(changed)
    return result if with_text else result.drop("kept")
