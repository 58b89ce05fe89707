"""Ranked lexical search: WAND over document shards.

``build_index`` cuts the documents into shards of about ``SHARD`` tokens. A shard holds
for each of its terms the documents with it in ascending order, how often it stands in
each, and two figures that bound the term's impact there whatever the table's averages
turn out to be. The index is a table in the shared folder, of use for many searches. Each
shard is a row group of its own, so that a task writes and reads one shard at a time and
needs the same memory however many shards its part of the files has.

``search`` takes the items in blocks of at most ``BLOCK`` different terms and ``ITEMS``
items, so that what is sent to every task, and its heaps, have a bound however many items
there are. A first pass over a
block sums the documents of each term; the second searches. An item walks a shard like
this: the terms' maximal impacts, cheapest first, are summed up to the pivot, the first
term with which the sum can reach the heap's threshold; a document with none of the terms
from the pivot on can't enter the heap, and a shard without a pivot is skipped. The
documents of the other terms are met in ascending order, and only those that hold terms
whose maxima add up to the threshold are scored, a run of ``RUN`` at a time, after which
the threshold has risen. A task keeps one heap of each item for all of its shards. What
the heaps hold meets in two steps, first a few tasks' heaps, then the rest, so that no
task gets all heaps of an item.

The score is a BM25 with b = 0.5 in whole numbers, so it is the same in every order of
summation; ``weight`` and ``impact`` give its parts.

Edge cases: a null text, or one without a term, isn't counted and never found; an item
without terms finds nothing; repeated documents each have a place; rows with equal scores
are ordered by ascending ``doc_id``, those without an id last; items with the same id are
ranked each by itself; a very long text is read whole; empty tables give no rows; extra
columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import materialize
from corvane.llm.decontamination import words

SHARD = 400_000
BLOCK = 1 << 17
ITEMS = 4096
RUN = 256
TOP = 50
MERGE = 64

#: A row of the index has megabytes; the writer would gather a hundred before it looks at their size, and a reader takes a whole row group.
ONE_BY_ONE = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}

INDEX_SCHEMA = "doc_ids array<{id}>, sizes array<bigint>, n_docs bigint, n_terms bigint, terms array<binary>, bounds binary, docs binary, counts binary, most binary, least binary"


def weight(df: int, n_docs: int) -> int:
    """Of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of documents of ``size`` terms, among ``n_docs`` that have ``n_terms`` together."""
    return 100 - 50 + (50 * size * n_docs) // max(n_terms, 1)


def impact(tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * factor)


class _Shard:
    """Postings gathered for one row of the index."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids, self.sizes, self.total = [], [], 0

    def add(self, doc_id, found: list[bytes]) -> None:
        count = Counter(found)
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, count), np.int32, len(count)))
        self.counts.append(np.fromiter(count.values(), np.int32, len(count)))
        self.total += len(found)

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        self.numbers.default_factory = None  # it holds the numbers, and in such a ring one shard after another would stay
        sizes = np.array(self.sizes, np.int64)
        term, count = np.concatenate(self.terms), np.concatenate(self.counts)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(t) for t in self.terms])
        by_term = np.argsort(term, kind="stable")
        bounds = np.searchsorted(term[by_term], np.arange(len(self.numbers) + 1)).astype(np.int32)
        doc, count = doc[by_term], count[by_term]
        most = np.maximum.reduceat(count, bounds[:-1])
        least = np.minimum.reduceat(sizes[doc] / count, bounds[:-1])
        one = lambda values, t: pa.array([values], pa.list_(t))
        whole = [pa.array([x], pa.int64()) for x in (len(sizes), self.total)]
        raw = [pa.array([x.tobytes()]) for x in (bounds, doc, count, most, least)]
        cols = [one(self.ids, kind), one(sizes, pa.int64()), *whole, one(list(self.numbers), pa.binary()), *raw]
        return pa.RecordBatch.from_arrays(cols, ["doc_ids", "sizes", "n_docs", "n_terms", "terms", "bounds", "docs", "counts", "most", "least"])


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The index of all rows of ``docs`` (``doc_id``, ``text``) that have a term, written to the shared folder."""
    kind = docs.schema["doc_id"].dataType
    arrow = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if found := words(text.as_py()):
                    now.add(doc_id, found)
                if now.total >= shard:
                    yield now.row(arrow)
                    now = _Shard()
        if now.ids:
            yield now.row(arrow)

    return materialize(docs.select("doc_id", "text").mapInArrow(run, INDEX_SCHEMA.format(id=kind.simpleString())), "lexical", **ONE_BY_ONE)


@dataclass(frozen=True)
class Items:
    """A block of items: ``(number, item_id, terms)`` with terms as numbers of a sorted vocabulary."""

    vocabulary: list[bytes]
    rows: list[tuple[int, object, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int, object, set[bytes]]]) -> Items:
        vocabulary = sorted(set().union(*(t for _, _, t in rows)))
        number = {w: k for k, w in enumerate(vocabulary)}
        return Items(vocabulary, [(k, item, np.array(sorted(number[w] for w in terms))) for k, item, terms in rows])


def _blocks(items: Iterable, size: int, most: int = ITEMS) -> Iterator[Items]:
    rows, held = [], set()
    for k, (item_id, text) in enumerate(items):
        if terms := set(words(text)):
            if rows and (len(rows) == most or len(held | terms) > size):
                yield Items.of(rows)
                rows, held = [], set()
            rows.append((k, item_id, terms))
            held |= terms
    if rows:
        yield Items.of(rows)


def _numbered(terms, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of a shard's terms the vocabulary has, and their numbers there."""
    known = pc.index_in(terms.values, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(known >= 0)
    return own, known[own]


def document_counts(index: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """For each term of the vocabulary the documents that hold it; one sum of each task meets in the result."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(sent.value, pa.binary())
        df = np.zeros(len(values), np.int64)
        for batch in batches:
            for terms, bounds in zip(batch.column(0), batch.column(1), strict=True):
                own, number = _numbered(terms, values)
                df[number] += np.diff(np.frombuffer(bounds.as_py(), np.int32))[own]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], ["term", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "bounds").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    sent.destroy()
    return out


class Heap:
    """The best rows of one item: score descending, then id ascending with null last."""

    def __init__(self, top: int) -> None:
        self.top, self.rows, self.threshold = top, [], 1

    def offer(self, scores: list[int], ids: list) -> None:
        self.rows += [(-s, d is None, 0 if d is None else d) for s, d in zip(scores, ids, strict=True)]
        self.rows.sort()
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.threshold = -self.rows[-1][0]


def walk(shard: ShardView, terms: np.ndarray, weights: np.ndarray, heap: Heap) -> int:
    """One item over one shard; returns the number of documents scored.

    ``terms`` are places in the shard's list of terms. A document that only reaches the
    threshold is scored too, since its id may be less.
    """
    maxima = weights * shard.maximum[terms]
    order = np.argsort(maxima, kind="stable")
    terms, weights, maxima = terms[order], weights[order], maxima[order]
    upto = np.cumsum(maxima)
    pivot = int(np.searchsorted(upto, heap.threshold))
    if pivot == len(terms):
        return 0
    reached = np.zeros(shard.n_docs, np.int64)
    at, which = shard.postings(terms[pivot:])
    np.add.at(reached, shard.docs[at], maxima[pivot:][which])
    below = int(upto[pivot - 1]) if pivot else 0
    left = np.flatnonzero(reached)
    left = left[reached[left] + below >= heap.threshold]
    if pivot and len(left):  # the cheap terms are looked at only in the documents that are left
        flag = np.zeros(shard.n_docs, bool)
        flag[left] = True
        low, which_low = shard.postings(terms[:pivot])
        keep = flag[shard.docs[low]]
        low, which_low = low[keep], which_low[keep]
        np.add.at(reached, shard.docs[low], maxima[:pivot][which_low])
        at, which = np.concatenate([low, at]), np.concatenate([which_low, which + pivot])
        left = left[reached[left] >= heap.threshold]
    scored = 0
    place = np.full(shard.n_docs, -1)
    while len(left):
        run, left = left[:RUN], left[RUN:]
        place[run] = np.arange(len(run))
        mine = place[shard.docs[at]]
        keep = mine >= 0
        score = np.zeros(len(run), np.int64)
        doc, k = shard.docs[at][keep], at[keep]
        np.add.at(score, mine[keep], weights[which[keep]] * impact(shard.counts[k].astype(np.int64), shard.factor[doc]))
        place[run] = -1
        scored += len(run)
        enter = np.flatnonzero(score >= heap.threshold)
        if len(enter) > heap.top:  # of one run only its own best can enter, ties included
            enter = enter[score[enter] >= np.partition(score[enter], -heap.top)[-heap.top]]
        heap.offer(score[enter].tolist(), [shard.ids[d] for d in run[enter].tolist()])
        left = left[reached[left] >= heap.threshold]
    return scored


class ShardView:
    """A row of the index as arrays."""

    def __init__(self, row: list, n_docs: int, n_terms: int) -> None:
        ids, sizes, bounds, docs, counts, most, least = row
        self.ids = ids.as_py()
        self.n_docs = len(self.ids)
        self.bounds, self.docs, self.counts, most = (np.frombuffer(x.as_py(), np.int32) for x in (bounds, docs, counts, most))
        self.factor = length_factor(np.array(sizes.values), n_docs, n_terms)
        # no document has a greater impact: tf is at most `most`, size / tf at least `least`, and rounding takes 1 off a factor at most
        factor_by_tf = 49 / most + 50 * n_docs / max(n_terms, 1) * np.frombuffer(least.as_py(), np.float64) * (1 - 1e-9)
        self.maximum = np.floor(1_000_000_000 / (1000 + 20 * factor_by_tf)).astype(np.int64) + 1

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``docs`` of the terms' postings, and for each which of ``terms`` it is of."""
        first, n = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        which = np.repeat(np.arange(len(terms)), n)
        return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n), which


def _best(index: DataFrame, block: Items, n_docs: int, n_terms: int, top: int, item_kind: str) -> DataFrame:
    """``number, item_id, doc_id, score, task``: what the heaps of all tasks hold after a block of items."""
    df = document_counts(index, block.vocabulary)
    sent = index.sparkSession.sparkContext.broadcast((block, np.array([weight(int(x), n_docs) if x else 0 for x in df], np.int64)))
    kind = index.schema["doc_ids"].dataType.elementType
    arrow, item_arrow = _arrow(kind), pa.string() if item_kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        vocabulary = pa.array(items.vocabulary, pa.binary())
        heaps = [Heap(top) for _ in items.rows]
        for batch in batches:
            for r in range(batch.num_rows):
                shard = ShardView([batch.column(k)[r] for k in (0, 1, 3, 4, 5, 6, 7)], n_docs, n_terms)
                own, number = _numbered(batch.column(2)[r], vocabulary)
                where = np.full(len(vocabulary), -1)
                where[number] = own
                for heap, (_, _, terms) in zip(heaps, items.rows, strict=True):
                    held = terms[(where[terms] >= 0) & (weights[terms] > 0)]
                    if len(held):
                        walk(shard, where[held], weights[held], heap)
        for heap, (k, item_id, _) in zip(heaps, items.rows, strict=True):
            n = len(heap.rows)
            ids = [None if absent else d for _, absent, d in heap.rows]
            cols = [pa.array([k] * n, pa.int64()), pa.array([item_id] * n, item_arrow), pa.array(ids, arrow), pa.array([-s for s, _, _ in heap.rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["number", "item_id", "doc_id", "score"])

    columns = index.select("doc_ids", "sizes", "terms", "bounds", "docs", "counts", "most", "least")
    found = columns.mapInArrow(run, f"number bigint, item_id {item_kind}, doc_id {kind.simpleString()}, score bigint")
    return found.withColumn("task", F.spark_partition_id() % MERGE)


def search(index: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``number, item_id, rank, doc_id, score``: the ``top`` best documents of each item with a score above 0.

    ``number`` tells items apart: their place in the reading.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    kind = kind if kind in ("bigint", "string") else "bigint" if kind in ("int", "smallint", "tinyint") else "string"
    rows = ((r["item_id"], r["text"]) for r in items.select(F.col("item_id").cast(kind), "text").toLocalIterator())
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks = _blocks(rows, block)
    held = [next(blocks, Items([], [])), next(blocks, None)]
    if held[1] is None:
        found = _best(index, held[0], n_docs, n_terms, top, kind)
    else:  # one block after another; only heaps are kept between them
        found = None
        for b in itertools.chain(held, blocks):
            part = materialize(_best(index, b, n_docs, n_terms, top, kind), "heaps")
            found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("number", "task").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("number", "item_id", "rank", "doc_id", "score")
