"""N-gram Jaccard self-join by chosen paths.

Texts become sets of hashed word shingles; equal sets are collapsed to one
representative first, so copies cost one row. Then, as in the chosen-path
recursion, representatives are split again and again on sampled shared tokens:
a path is a run number and a sequence of tokens, each the least token of the set
under a hash function that the path so far chooses. Sets that share a path meet
in its bucket. Buckets of at most ``SMALL`` sets are compared by brute force;
larger ones are split on ``BRANCHES`` further tokens, at most ``DEPTH`` times, and
what is still large then (sets that agree in all sampled tokens) is compared in
pairs of blocks of about ``BLOCK`` sets and ``BLOCK_BYTES`` bytes, so no bucket is
capped and no task holds more than two blocks.

How often runs are repeated, and in how many sampled tokens two sets must agree to
be compared exactly, both follow from ``threshold`` and ``recall``: a pair at the
threshold is missed by either with at most half the probability 1 - ``recall``.

A pair is counted in one bucket only: the least path that its two sets share.
Bucket tasks first compare signatures, and only sets with a likely partner there
have their texts brought, for the exact comparison. Bucket tasks return sums of
links and one spanning edge per set, never the pairs. Rows are told apart by a
generated number, never by their ids, so rows without an id or with a repeated one
cost no more than others.

Edge cases: a text of one to four words is a single shingle; null, empty and
blank texts have no shingle, no link and a class of their own; repeated rows and
equal texts share a class; a class's id is its least ``doc_id`` (null if it has
none); a very long text is read whole, in pieces; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import vector
from corvane.llm.common import materialize, release
from corvane.llm.components import components

WORDS = 5
THRESHOLD = 0.8
SIGNATURE = 48
SMALL = 256
BRANCHES = 2
DEPTH = 2
BLOCK = 1024
BLOCK_BYTES = 8 << 20
RECALL = 0.999999


@functools.lru_cache(maxsize=4)
def _functions(places: int) -> tuple[np.ndarray, np.ndarray]:
    """Constants of the hash functions under which least tokens are taken."""
    draw = np.random.default_rng(977)
    return draw.integers(0, 2**63, places, dtype=np.uint64), draw.integers(0, 2**62, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray, n: int, hashes: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """First shingle of each row (one more entry at the end) and the shingles' hashes."""
    _, _, rows, h = vector.words(raw, at, hashes)
    size = np.diff(rows)
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(first[-1]) - np.repeat(first[:-1] - rows[:-1], count)
    end = np.minimum(start + n, np.repeat(rows[1:], count))
    return first, [vector.Rolling(x, k).of(start, end) for k, x in enumerate(h)]


def runs_for(recall: float, threshold: float, depth: int = DEPTH, branches: int = BRANCHES) -> int:
    """Runs until a pair at the threshold shares no leaf with at most half the probability 1 - ``recall``."""
    once = threshold * (1 - (1 - threshold) ** branches) ** depth
    return math.ceil(math.log((1 - recall) / 2) / math.log(1 - once)) if once < 1 else 1


def agreeing_for(recall: float, threshold: float, places: int) -> int:
    """The most places that two sets must agree in: a pair at the threshold agrees in
    fewer with at most half the probability 1 - ``recall``."""
    below = 0.0
    for k in range(places + 1):
        below += math.comb(places, k) * threshold**k * (1 - threshold) ** (places - k)
        if below > (1 - recall) / 2:
            return k
    return places


def signatures(docs: DataFrame, n: int = WORDS, places: int = SIGNATURE) -> DataFrame:
    """``doc_id, text, h1, h2, sig``: the hash of the row's shingles and its least tokens; null without shingles."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, odd = _functions(places)
        for batch in batches:
            raw, at = vector.utf8(batch.column(1))
            for a, b in vector.row_groups(at):
                first, (s, t) = shingles(raw[at[a] : at[b]], at[a : b + 1] - at[a], n)
                full = np.flatnonzero(np.diff(first))
                cut = first[:-1][full]
                h1, h2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                sig = np.zeros((b - a, places), np.uint32)
                if len(full):
                    h1[full], h2[full] = (vector.mix(np.add.reduceat(vector.mix(x), cut)) for x in (s, t))
                    for k in range(places):
                        sig[full, k] = (np.minimum.reduceat((s ^ xor[k]) * odd[k], cut) >> np.uint64(32)).astype(np.uint32)
                empty = np.ones(b - a, bool)
                empty[full] = False
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int32).ravel()), places).cast(pa.list_(pa.int32()))
                cols = [*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(h1.view(np.int64), mask=empty), pa.array(h2.view(np.int64), mask=empty), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "h1", "h2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, text string, h1 bigint, h2 bigint, sig array<int>")


def _leaves(sets: DataFrame, runs: int, places: int) -> DataFrame:
    """``path, rid, members, weight``: the buckets in which sets are compared, two members at least."""
    root = F.array(*[F.xxhash64(F.lit(r), F.get("sig", F.lit(r))) for r in range(runs)])
    level = sets.select("rid", "bytes", F.explode(root).alias("path"))
    out = None
    for depth in range(DEPTH + 1):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("weight")).filter("members > 1")
        level = materialize(level.join(sizes, "path"), "paths")
        leaf = (level if depth == DEPTH else level.filter(F.col("members") <= SMALL)).drop("bytes")
        out = leaf if out is None else out.unionByName(leaf)
        if depth == DEPTH:
            break
        wide = level.filter(F.col("members") > SMALL)
        if wide.isEmpty():
            break
        pick = lambda j: F.pmod(F.xxhash64("path", F.lit(j)), F.lit(places)).cast("int")
        deeper = F.array(*[F.xxhash64("path", F.lit(j), F.get("sig", pick(j))) for j in range(BRANCHES)])
        level = wide.select("rid", "bytes", "path").join(sets.select("rid", "sig"), "rid").select("rid", "bytes", F.explode(deeper).alias("path"))
    return out


def _blocked(leaves: DataFrame) -> DataFrame:
    """Adds the block pair of a bucket: of a bucket with more sets or bytes than a block holds,
    one task gets each pair of blocks."""
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("weight") / BLOCK_BYTES), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    rows = leaves.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("path", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), "rid", F.col("_own").alias("own"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (path, x, y) after another; batches come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _countable(group: pa.Table) -> np.ndarray:
    """Pairs of the group that belong to this bucket and block pair: their least shared path is this one."""
    path, x, y = (group.column(k)[0].as_py() for k in range(3))
    own = np.asarray(group.column("own"))
    pair = (own[:, None] == x) & (own[None, :] == y)
    if x != y:
        pair |= pair.T
    np.fill_diagonal(pair, False)
    lists = group.column("leaves").combine_chunks()
    owner = np.repeat(np.arange(len(own)), np.diff(np.asarray(lists.offsets)))
    value = np.asarray(lists.flatten())
    less = value < path
    owner, value = owner[less], value[less]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    cut = np.append(np.flatnonzero(np.diff(value, prepend=value[0] - 1 if len(value) else 0)), len(value))
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a > 1:
            pair[np.ix_(owner[a:b], owner[a:b])] = False
    return pair


def _likely(agreeing: int):
    """Keeps the rows of a bucket that agree with another one in ``agreeing`` places of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            pair = _countable(group)
            if not pair.any():
                continue
            sig = np.asarray(group.column("sig").combine_chunks().flatten()).reshape(group.num_rows, -1)
            agree = np.zeros(pair.shape, np.uint16)
            for k in range(sig.shape[1]):
                agree += sig[:, k][:, None] == sig[:, k][None, :]
            keep = (pair & (agree >= agreeing)).any(axis=1)
            if keep.any():
                yield from group.select(["path", "x", "y", "rid", "own", "leaves", "copies"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by blocked products of the 0/1 matrix of shared tokens."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, where, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = n > 1
    column = np.cumsum(several) - 1
    use = several[where]
    owner, place = owner[use], column[where[use]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = max(256, min(8192, (1 << 22) // max(1, len(sets))))
    for first in range(0, int(several.sum()), width):
        a, b = np.searchsorted(place, [first, first + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], place[a:b] - first] = 1
        total += m @ m.T
    return total


def _roots(link: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row: the connected component of links of Jaccard
    similarity ``threshold`` or more, and the number of other rows that the row links to."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold and recall are shares")
    runs = runs_for(recall, threshold)
    places = max(SIGNATURE, runs)
    rows = materialize(signatures(docs, n, places).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    full = rows.filter("h1 is not null").select("doc_id", "h1", "h2", "rid", "sig", F.octet_length("text").cast("long").alias("bytes"))
    # the row with the least number stands for all rows with its set
    sets = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("rid").alias("rid"), F.max("bytes").alias("bytes"), F.first("sig").alias("sig"))
    sets = materialize(sets, "sets")
    leaves = materialize(_leaves(sets, runs, places), "leaves")
    own = leaves.groupBy("rid").agg(F.collect_set("path").alias("leaves"))  # at most runs * BRANCHES^DEPTH
    key = ["path", "x", "y"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *key).sortWithinPartitions(*key)

    described = sets.select("rid", "sig", "copies").join(own, "rid")
    buckets = _blocked(leaves.distinct()).join(described, "rid").select(*key, "rid", "own", "sig", "leaves", "copies")
    near = _likely(agreeing_for(recall, threshold, places))
    likely = materialize(dealt(buckets).mapInArrow(near, "path bigint, x int, y int, rid bigint, own int, leaves array<bigint>, copies bigint"), "likely")
    # merged at every size: one plan, whose traffic grows with the input and no faster
    texts = rows.select("rid", "text").join(likely.select("rid").distinct().hint("merge"), "rid")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            raw, at = vector.utf8(group.column("text"))
            tokens = []
            for a, b in vector.row_groups(at):
                first, (s,) = shingles(raw[at[a] : at[b]], at[a : b + 1] - at[a], n, 1)
                tokens += [np.unique(s[i:j]) for i, j in zip(first, first[1:], strict=False)]
            size = np.array([len(t) for t in tokens], np.float64)
            both = _shared(tokens)
            link = _countable(group)
            for a in range(0, len(link), 64):
                part = both[a : a + 64].astype(np.float64)
                link[a : a + 64] &= part >= threshold * (size[a : a + 64, None] + size[None, :] - part) - 1e-9
            linked = link.any(axis=1)
            if linked.any():
                rid, copies = np.asarray(group.column("rid")), np.asarray(group.column("copies"))
                links = np.array([copies[x].sum() for x in link[linked]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rid[linked]), pa.array(rid[_roots(link)][linked]), pa.array(links)], ["a", "b", "links"])

    checked = dealt(likely.join(texts, "rid").select(*key, "rid", "own", "leaves", "copies", "text"))
    found = materialize(checked.mapInArrow(exact, "a bigint, b bigint, links bigint"), "found")
    release(leaves, likely)
    root = components(found)
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    sets = sets.select("h1", "h2", "rid", "least", "copies").join(root, F.col("rid") == F.col("node"), "left").join(links, F.col("rid") == F.col("a"), "left")
    sets = sets.select("h1", "h2", "copies", "least", F.coalesce("root", "rid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = sets.groupBy("root").agg(F.min("least").alias("class_id"))
    sets = sets.join(classes, "root").select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "copies", "links", "class_id")
    out = rows.select("doc_id", "h1", "h2").join(sets, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    class_id: Column = F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    n_links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long")
    return out.select("doc_id", class_id.alias("class_id"), n_links.alias("n_links"))
