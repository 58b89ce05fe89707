"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every training token: each row of the index
is a segment of about ``SEGMENT`` tokens that holds its terms and, for each term,
the ascending places where it stands. Places of one segment run on from document to
document with a gap between them, so a phrase can't cross two.

``search`` turns the test items into phrases, in blocks of at most ``BLOCK`` phrases,
so that what is sent to every task has a bound however many or long the items are;
several blocks are searched one after another, and only hits are kept between them.
In a segment, the terms that it shares with the block lead to the phrases whose
rarest term they are, and only those with all terms present are looked at. Such a phrase
starts from its rarest list and intersects the offset-adjusted lists of the other terms,
rarest first, all phrases together.

``slop`` > 0 is proximity search: a phrase is found at a start s inside one document
if each term k of it stands within ``slop`` places of s + k there; the words hit are
all those that so match. One word may match a term that the phrase repeats twice.

No row is ever shuffled by a term, so frequent words and passages that a third of
the rows share cost no more than their own segment. Edge cases: null text has no
words and no hits; repeated documents each get their row; a very long text is indexed
whole; an item without words has no window; of equal items all are listed; an item
without an id marks words but isn't listed; an empty benchmark hits nothing; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import materialize

#: Bytes of UTF-8 as the word rule has them: A-Z in lower case, ASCII that is no letter or digit as a space.
_RULE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WINDOW = 13
SEGMENT = 400_000
BLOCK = 1 << 17
#: Places where phrases may start that are looked at together.
STARTS = 1 << 20

INDEX_SCHEMA = "segment string, doc_ids array<{id}>, starts array<bigint>, sizes array<bigint>, terms array<binary>, bounds binary, places binary"


def words(text: str | bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8; null has none."""
    return (text if isinstance(text, bytes) else (text or "").encode()).translate(_RULE).split()


def windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []


class _Segment:
    """Tokens gathered for one row of the index."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.parts: list[np.ndarray] = []
        self.ids, self.starts, self.sizes, self.at = [], [], [], 0

    def add(self, doc_id, found: list[bytes], gap: int) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.at)
        self.sizes.append(len(found))
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
        self.at += len(found) + gap

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        term = np.concatenate([np.zeros(0, np.int32), *self.parts])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(s, s + n) for s, n in zip(self.starts, self.sizes, strict=True)]]).astype(np.int32)
        names = list(self.numbers)
        by_term = np.argsort(term, kind="stable")
        bounds = np.searchsorted(term[by_term], np.arange(len(names) + 1)).astype(np.int32)
        one = lambda values, t: pa.array([values], pa.list_(t))
        cols = [pa.array([uuid.uuid4().hex]), one(self.ids, kind), one(self.starts, pa.int64()), one(self.sizes, pa.int64()), one(names, pa.binary()), pa.array([bounds.tobytes()]), pa.array([place[by_term].tobytes()])]
        return pa.RecordBatch.from_arrays(cols, ["segment", "doc_ids", "starts", "sizes", "terms", "bounds", "places"])


def build_index(docs: DataFrame, gap: int = 64) -> DataFrame:
    """The index of all rows of ``docs`` (``doc_id``, ``text``), written to the shared folder."""
    kind = docs.schema["doc_id"].dataType
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                segment.add(doc_id, words(text), gap)
                if segment.at >= SEGMENT:
                    yield segment.row(arrow)
                    segment = _Segment()
        if segment.ids:
            yield segment.row(arrow)

    rows = docs.select(F.col("doc_id"), F.col("text"))
    return materialize(rows.mapInArrow(run, INDEX_SCHEMA.format(id=kind.simpleString())), "postings")


@dataclass(frozen=True)
class Phrases:
    """A block of phrases, as numbers of a sorted vocabulary."""

    vocabulary: list[bytes]
    terms: np.ndarray  # one row for each phrase, -1 beyond its end
    by_rarest: np.ndarray  # phrases in order of their rarest term in the block
    bounds: np.ndarray  # of each term its first phrase in by_rarest, one more at the end
    items: list[tuple[str, ...]]

    @staticmethod
    def of(found: dict[tuple[bytes, ...], set]) -> Phrases:
        used = Counter(w for p in found for w in set(p))
        vocabulary = sorted(used)
        number = {w: k for k, w in enumerate(vocabulary)}
        terms = np.full((len(found), max(map(len, found), default=0)), -1, np.int32)
        rarest = np.zeros(len(found), np.int32)
        for k, p in enumerate(found):
            terms[k, : len(p)] = [number[w] for w in p]
            rarest[k] = number[min(p, key=lambda w: (used[w], w))]
        order = np.argsort(rarest, kind="stable").astype(np.int32)
        bounds = np.searchsorted(rarest[order], np.arange(len(vocabulary) + 1))
        return Phrases(vocabulary, terms, order, bounds, [tuple(sorted(x for x in ids if x is not None)) for ids in found.values()])

    def candidates(self, present: np.ndarray) -> np.ndarray:
        """Phrases all of whose terms are ``present`` (a flag for each term)."""
        there = np.flatnonzero(present)
        first, n = self.bounds[there], self.bounds[there + 1] - self.bounds[there]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        found = self.by_rarest[np.repeat(first, n) + inner]
        return found[(present[self.terms[found]] | (self.terms[found] < 0)).all(axis=1)]


def _blocks(items: Iterable, size: int) -> Iterator[Phrases]:
    """Phrases and the ids of the items that have them, ``size`` phrases at a time."""
    block: dict[tuple[bytes, ...], set] = {}
    for item_id, text in items:
        for phrase in windows(text):
            block.setdefault(phrase, set()).add(None if item_id is None else str(item_id))
            if len(block) >= size:
                yield Phrases.of(block)
                block = {}
    if block:
        yield Phrases.of(block)


def _find(places: np.ndarray, bounds: np.ndarray, terms: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(phrase, place)`` of the words that match, for all phrases together, some at a time.

    ``terms`` has a row for each phrase: numbers of the segment's lists, -1 beyond its end.
    Each phrase's rarest list is moved to where the phrase would start, and then its other
    lists, rarest first, are intersected with what is left of all phrases in one search
    each: lists are kept one after the other, so list and place make one ascending number.
    """
    if not len(terms) or not len(starts):
        return
    width, span = terms.shape[1], int(starts[-1] + sizes[-1]) + 2 * slop + 2
    keys = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64) * span, np.diff(bounds)) + places
    n = np.where(terms >= 0, np.diff(bounds)[terms], np.iinfo(np.int64).max)
    order = np.argsort(n, axis=1, kind="stable")
    length = (terms >= 0).sum(axis=1)
    cost = n[np.arange(len(terms)), order[:, 0]] * (2 * slop + 1)
    moved = np.arange(-slop, slop + 1)
    for block in np.split(np.arange(len(terms)), np.flatnonzero(np.diff(np.cumsum(cost) // STARTS)) + 1):
        rare = order[block, 0]
        first, many = bounds[terms[block, rare]], n[block, rare]
        phrase = np.repeat(block, many)
        here = places[np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)].astype(np.int64)
        doc = np.searchsorted(starts, here, "right") - 1
        start = (here[:, None] - np.repeat(rare, many)[:, None] + moved).ravel()
        phrase, doc = np.repeat(phrase, len(moved)), np.repeat(doc, len(moved))
        low, high = starts[doc], starts[doc] + sizes[doc] - 1

        def reach(at: np.ndarray, which: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            base = terms[which, at].astype(np.int64) * span
            from_, to = np.maximum(begin + at - slop, low), np.minimum(begin + at + slop, high)
            left = np.searchsorted(keys, base + from_)
            if slop:
                return left, np.where(from_ <= to, np.searchsorted(keys, base + to, "right"), left)
            there = (from_ <= to) & (keys[np.minimum(left, len(keys) - 1)] == base + from_)
            return left, left + there

        for k in range(1, width):
            due = k < length[phrase]
            if not due.any():
                break
            left, right = reach(order[phrase[due], k], phrase[due], start[due], low[due], high[due])
            keep = ~due
            keep[due] = left < right
            phrase, start, low, high = phrase[keep], start[keep], low[keep], high[keep]
        for k in range(width):
            due = k < length[phrase]
            left, right = reach(np.full(int(due.sum()), k), phrase[due], start[due], low[due], high[due])
            for step in range(2 * slop + 1):
                there = left + step < right
                yield phrase[due][there], places[(left + step)[there]].astype(np.int64)


def search(index: DataFrame, items: DataFrame, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` for every document of the index."""
    spark = index.sparkSession
    blocks = _blocks(((r["item_id"], r["text"]) for r in items.select("item_id", "text").toLocalIterator()), block)
    held = [next(blocks, Phrases.of({})), next(blocks, None)]
    if held[1] is None:
        return _pass(index, spark.sparkContext.broadcast(held[0]), slop, False).select("doc_id", "n_words", "n_hit", "items")
    parts = []
    for phrases in itertools.chain(held, blocks):
        sent = spark.sparkContext.broadcast(phrases)
        parts.append(materialize(_pass(index, sent, slop, True).filter("n_hit > 0").select("segment", "place", "hit", "items"), "hits"))
        sent.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("segment", "place").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("place", "d")).select("segment", F.col("place").cast("long").alias("place"), "d.doc_ids", "d.sizes")
    found = docs.join(merged, ["segment", "place"], "left")
    return found.select(F.col("doc_ids").alias("doc_id"), F.col("sizes").alias("n_words"), F.coalesce("n", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("i", F.array().cast("array<string>")).alias("items"))


def _pass(index: DataFrame, sent, slop: int, with_places: bool) -> DataFrame:
    """One block of phrases against every segment; ``with_places`` adds the words hit and where the document's row is."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>" + (", hit array<bigint>, segment string, place bigint" if with_places else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = sent.value
        vocabulary = pa.array(phrases.vocabulary, pa.binary())
        for batch in batches:
            for r in range(batch.num_rows):
                segment, ids, starts, sizes, terms, bounds, places = (batch.column(k)[r] for k in range(7))
                starts, sizes = np.array(starts.values), np.array(sizes.values)
                bounds, places = np.frombuffer(bounds.as_py(), np.int32), np.frombuffer(places.as_py(), np.int32)
                known = pc.index_in(terms.values, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                own = np.flatnonzero(known >= 0)
                where = np.full(len(vocabulary) + 1, -1)
                where[known[own]] = own
                hit = np.zeros(int(starts[-1] + sizes[-1]) if len(starts) else 0, bool)
                found: dict[int, set] = {}
                there = phrases.candidates(where[:-1] >= 0)
                lists = np.where(phrases.terms[there] >= 0, where[phrases.terms[there]], -1)
                pairs: list[np.ndarray] = []
                for which, at in _find(places, bounds.astype(np.int64), lists, starts, sizes, slop):
                    hit[at] = True
                    pairs.append(np.unique((np.searchsorted(starts, at, "right") - 1) * len(there) + which))
                for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
                    found.setdefault(pair // len(there), set()).update(phrases.items[there[pair % len(there)]])
                upto = np.concatenate([[0], np.cumsum(hit)])
                n_hit = upto[starts + sizes] - upto[starts]
                items = [sorted(found.get(d, ())) for d in range(len(starts))]
                cols = [ids.values, pa.array(sizes, pa.int64()), pa.array(n_hit.astype(np.int64)), pa.array(items, pa.list_(pa.string()))]
                names = ["doc_id", "n_words", "n_hit", "items"]
                if with_places:
                    marked = [np.flatnonzero(hit[s : s + n]) if h else [] for s, n, h in zip(starts, sizes, n_hit, strict=True)]
                    cols += [pa.array(marked, pa.list_(pa.int64())), pa.array([segment.as_py()] * len(starts), pa.string()), pa.array(np.arange(len(starts)))]
                    names += ["hit", "segment", "place"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return index.mapInArrow(run, schema)


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)
