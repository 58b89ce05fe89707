"""Prefix trie of conversations, merged family by family.

Each conversation is first rebuilt: the first h turns of its family's base conversation
(``base_id``), then its own turns after its first h, with h from a checksum of its id.
A node of the trie is a distinct sequence of first turns; it is known by a key that adds
up, for each turn, four 31-bit numbers from the SHA-256 of the turn and its place. Such
keys need no order of computation, so those of a very long conversation are running sums.

``build`` cogroups the turns of each family with those of its base by the base's id,
rebuilds its conversations, builds their small trie, and shuffles only the family's
combined nodes for the global merge. Texts are read once and go no further than their
digest and length. A family of more than ``LONG`` turns isn't given to one task: its
turns are placed, and its keys summed, by ranges over all tasks.

What is counted over subtrees is summed along chains: a node belongs to the chain of the
smallest conversation that passes it, so a conversation's own nodes are the end of its
path, and the chain hangs from a node of a chain with a smaller id. Chains add up over
their chains in rounds that double the distance, so there are as many as the logarithm of
how deep chains hang on chains; inside a chain running sums by ranges give each node's.

A node's digest of the conversations that end there needs their ids in order. Ids are
sorted by ranges and packed into rows of up to ``PACK`` ids; one task then reads a node's
rows and hashes them one after the other without holding them. A hash can't be split
further: of a node where a third of all conversations end, their ids go through one task.

Edge cases: a null role or text is empty; null turns come first, and equal ones are
ordered by the SHA-256 of role and text; repeated rows are turns of their own; a
conversation shorter than h has no turns of its own left and may be turnless; rows
without a ``conv_id`` are no conversation's and passed over; very long texts are hashed
whole; an empty table gives no node, not even a root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_by_count, materialize, running_sums

FAMILY = 5
HEADS = 9
LONG = 50_000
PACK = 4096
LANES = ("k0", "k1", "k2", "k3")

NODE_SCHEMA = "key binary, parent binary, depth bigint, bytes bigint, n_convs bigint, conv_id bigint, ends array<bigint>"
_NODES = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.list_(pa.int64()))])


def base_id(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def turns(conversations: DataFrame) -> DataFrame:
    """``base, conv_id, h, turn, digest, bytes`` for each turn, written once."""
    c = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *[F.coalesce(n, F.lit("")).cast("binary").alias(n) for n in ("role", "text")])
    said = F.concat(F.concat(F.octet_length("role").cast("string"), F.lit(":")).cast("binary"), "role", "text")
    c = c.select(base_id(F.col("conv_id")).alias("base"), "conv_id", head_length(F.col("conv_id")).alias("h"), "turn", F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"))
    return materialize(c, "turns")


def lanes(digests: list[bytes]) -> np.ndarray:
    """The four numbers of each turn of a rebuilt conversation, one row for each turn."""
    raw = b"".join(hashlib.sha256(d + k.to_bytes(8, "big")).digest()[:16] for k, d in enumerate(digests, 1))
    return (np.frombuffer(raw, ">u4").reshape(-1, 4) & 0x7FFFFFFF).astype(np.int64)


def lane_columns(digest: Column, depth: Column) -> dict[str, Column]:
    """``lanes`` in columns."""
    h = F.sha2(F.concat(digest, F.unhex(F.lpad(F.hex(depth), 16, "0"))), 256)
    return {n: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF)) for k, n in enumerate(LANES)}


def key_column(parts: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]))


def _in_order(table: pa.Table) -> pa.Table:
    # a null turn sorts first
    t = table.append_column("_given", table.column("turn").is_valid())
    return t.sort_by([("conv_id", "ascending"), ("_given", "ascending"), ("turn", "ascending"), ("digest", "ascending")])


def family_nodes(own: pa.Table, base: pa.Table) -> pa.Table:
    """The combined nodes of one family, from its turns and its base's."""
    own, base = _in_order(own), _in_order(base)
    head_digests, head_bytes = base.column("digest").to_pylist(), base.column("bytes").to_pylist()
    digests, size = own.column("digest").to_pylist(), own.column("bytes").to_pylist()
    ids, h = own.column("conv_id").to_numpy(), own.column("h").to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
    nodes: dict[bytes, list] = {}
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        c, n = int(ids[first]), int(h[first])
        said = head_digests[:n] + digests[min(first + n, last) : last]
        length = [0, *head_bytes[:n], *size[min(first + n, last) : last]]
        sums = np.zeros((len(said) + 1, 4), ">i8")
        np.cumsum(lanes(said), axis=0, out=sums[1:])
        keys = [row.tobytes() for row in sums]
        for depth, key in enumerate(keys):
            node = nodes.get(key)
            if node is None:  # conversations come in ascending order
                node = nodes[key] = [keys[depth - 1] if depth else None, depth, length[depth], 0, c, []]
            node[3] += 1
            if depth == len(said):
                node[5].append(c)
    return pa.Table.from_arrays([pa.array(list(nodes), pa.binary()), *[pa.array(x, t) for x, t in zip(zip(*nodes.values(), strict=True), _NODES.types[1:], strict=True)]], schema=_NODES)


def _long_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of families that are too long for one task, one for each conversation and depth."""
    at = running_sums(rows, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest")], {"before": F.lit(1)}, "long-turns")
    each = materialize(at.groupBy("conv_id", "base", "h").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("start")), "long-conversations")
    at = join_by_count(at.drop("base", "h"), each, "conv_id", "n").withColumn("pos", F.col("before") - F.col("start") + 1)
    bases = each.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    members = each.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("n_head"), "n")
    heads = at.filter(f"conv_id = base and pos < {HEADS}").select("base", F.col("pos").alias("depth"), "digest", "bytes")
    heads = members.join(heads, "base").filter("depth <= h").select("conv_id", "depth", "digest", "bytes")
    short = members.select("conv_id", "n_head", (F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    sizes = materialize(short.join(each.select("conv_id", "n"), "conv_id"), "long-members")
    tails = join_by_count(at.filter("pos > h").select("conv_id", "pos", "h", "digest", "bytes"), sizes, "conv_id", "n")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("depth"), "digest", "bytes")
    turn = lane_columns(F.col("digest"), F.col("depth"))
    summed = running_sums(heads.unionByName(tails).withColumns(turn), [F.col("conv_id"), F.col("depth")], {f"s{n}": F.col(n) for n in LANES}, "long-keys")
    starts = materialize(summed.groupBy("conv_id").agg(*[F.min(f"s{n}").alias(f"b{n}") for n in LANES]).join(sizes, "conv_id"), "long-starts")
    summed = join_by_count(summed, starts, "conv_id", "n")
    ends = lambda here: F.when(here, F.array("conv_id")).otherwise(F.array().cast("array<bigint>")).alias("ends")
    up = [F.col(f"s{n}") - F.col(f"b{n}") for n in LANES]
    nodes = summed.select(
        key_column([u + F.col(n) for u, n in zip(up, LANES, strict=True)]).alias("key"), key_column(up).alias("parent"), "depth", "bytes", F.lit(1).cast("bigint").alias("n_convs"), "conv_id", ends(F.col("depth") == F.col("total"))
    )
    root = key_column([F.lit(0).cast("bigint")] * 4)
    roots = sizes.select(root.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("n_convs"), "conv_id", ends(F.col("total") == 0))
    return nodes.unionByName(roots)


def families(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """``NODE_SCHEMA``: the nodes of each family, combined in it, written once."""
    rows = turns(conversations)
    sizes = rows.groupBy("base").count()
    large = materialize(sizes.filter(F.col("count") > long).select("base"), "long-families")
    some = not large.isEmpty()
    usual = rows.join(large, "base", "left_anti") if some else rows
    base = usual.filter("conv_id = base").select(*[F.col(c).alias(c) for c in usual.columns])  # columns of its own, or the cogroup can't tell the sides apart
    found = usual.groupBy("base").cogroup(base.groupBy("base")).applyInArrow(family_nodes, NODE_SCHEMA)
    if some:
        found = found.unionByName(_long_nodes(rows.join(large, "base", "left_semi")))
    return materialize(found, "family-nodes")


def _chain_totals(chains: DataFrame, names: list[str]) -> DataFrame:
    """Adds up the named columns over each chain and all that hang on it, directly or not."""
    now = materialize(chains.select("conv_id", "up", *names), "chains")
    while not now.filter("up is not null").isEmpty():
        given = now.filter("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(n).alias(f"more_{n}") for n in names], F.count(F.lit(1)).alias("n_hung"))
        summed = materialize(now.join(given, "conv_id", "left"), "chain-sums")
        # where a chain's own parent hangs; only parents are looked up, by how many ask
        above = summed.filter("n_hung > 0").select(F.col("conv_id").alias("up"), F.col("up").alias("next"), F.col("n_hung").alias("asked"))
        above = materialize(above, "chain-parents")
        sums = [(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in names]
        moved = join_by_count(summed.filter("up is not null"), above, "up", "asked").select("conv_id", F.col("next").alias("up"), *sums)
        now = materialize(moved.unionByName(summed.filter("up is null").select("conv_id", "up", *sums)), "chains")
    return now.drop("up")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a key as rows of up to ``PACK`` ids, comma-joined."""
    key, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "ids"])

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PACK):
                yield row()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's packed rows in order."""
    key, state = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    yield row()
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
    if state is not None:
        yield row()


def end_digests(family: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes where two or more conversations end."""
    parts = max(1, int(family.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = materialize(nodes.filter("n_ends > 1").select("key", "n_ends"), "shared-ends")
    ends = family.filter(F.size("ends") > 0).select("key", F.explode("ends").alias("id"))
    ends = join_by_count(ends, many, "key", "n_ends").select("key", "id")
    packed = ends.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_packed, "key binary, first bigint, ids string")
    return packed.repartition(parts, "key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def build(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """One row for each node: ``key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    family = families(conversations, long)
    merged = family.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum(F.size("ends")).alias("n_ends"), F.min(F.array_min("ends")).alias("end"),
    )
    merged = materialize(merged, "nodes")
    kids = merged.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(merged.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("asked"))
    below = join_by_count(nodes.filter("parent is not null"), materialize(parents, "parents"), "parent", "asked").drop("asked")
    nodes = below.unionByName(nodes.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    own = {"leaves": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}
    nodes = materialize(nodes.withColumns(own), "nodes-parents")

    top = F.min(F.struct("depth", "parent_conv_id"))
    chains = nodes.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), top.alias("top"), F.count(F.lit(1)).alias("n"))
    chains = materialize(chains.select("*", F.col("top.parent_conv_id").alias("up"), (F.col("top.depth") - 1).alias("hook")).drop("top"), "chains")
    totals = _chain_totals(chains, ["leaves", "saved"])
    hung = chains.select("conv_id", "up", "hook").filter("up is not null").join(totals, "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), F.col("hook").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    worth = {n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in ("leaves", "saved")}
    rows = nodes.join(hung, ["conv_id", "depth"], "left").withColumns(worth).drop("more_leaves", "more_saved")
    rows = running_sums(rows, [F.col("conv_id"), F.desc("depth")], {f"before_{n}": F.col(n) for n in worth}, "chain-nodes")
    starts = rows.groupBy("conv_id").agg(*[F.min(f"before_{n}").alias(f"start_{n}") for n in worth], F.count(F.lit(1)).alias("asked"))
    rows = join_by_count(rows, materialize(starts, "chain-starts"), "conv_id", "asked")

    subtree = lambda n: F.col(f"before_{n}") - F.col(f"start_{n}") + F.col(n)
    alone = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)
    rows = rows.join(end_digests(family, merged), "key", "left")
    return rows.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", subtree("leaves").alias("n_leaves"), subtree("saved").alias("saved_tokens"), F.coalesce("ends_sha256", alone).alias("ends_sha256"))
