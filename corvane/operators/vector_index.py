"""Nearest known vector within a cosine distance, exact, for collections of any size.

A small collection, whose size is checked, is sent to every task. A larger one is dealt
into cells around at most ``CENTRES`` of its own vectors. On the unit sphere a cosine
distance d is a straight one of sqrt(2d), so a cell whose farthest vector is r from its
centre holds nothing within ``limit`` of a query that is farther than r + sqrt(2 limit)
from that centre: such cells are passed over, all others are compared, and the answer is
that of comparing all. Cells are put together to blocks of about ``BLOCK`` vectors, a
larger one is split; queries go to the blocks that they need, each block's queries in
parts of about ``BLOCK``, and block and part meet in one task as a matrix product. Both
sides are shuffled by block; only centres and radii are sent to all tasks.

Where vectors have no clusters, a distance excludes little, and each query goes to most
blocks: one in ``BLOCK`` of the collection, not to each vector's cell.

Null vectors, those with a null, infinite or not-a-number entry, of length 0 or of
another dimension than the collection's are near nothing, on both sides. Of equally near
vectors the least id counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 2000
CENTRES = 1024
BLOCK = 16_384
TILE = 1024


def units(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are vectors of the dimension, or any, and their unit vectors (none if dimensions differ and none is given)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.list_(pa.float64()))
    size = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    dimension = dimension or int(size.max(initial=0))
    rows = np.flatnonzero((size == dimension) & (dimension > 0))
    if not len(rows):
        return rows, np.zeros((0, max(dimension, 1)))
    v = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    with np.errstate(invalid="ignore", over="ignore"):
        length = np.linalg.norm(v, axis=1)
    ok = np.isfinite(length) & (length > 0)
    return rows[ok], v[ok] / length[ok, None]


def best(queries: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the first of its nearest among ``known``, and its cosine distance, by tiles."""
    at, far = np.zeros(len(queries), np.int64), np.full(len(queries), np.inf)
    for k in range(0, len(known), 4 * TILE):
        for q in range(0, len(queries), TILE):
            d = 1 - queries[q : q + TILE] @ known[k : k + 4 * TILE].T
            n = d.argmin(axis=1)
            near = d[np.arange(len(n)), n]
            closer = near < far[q : q + TILE]
            at[q : q + TILE][closer] = n[closer] + k
            far[q : q + TILE][closer] = near[closer]
    return at, far


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is a vector with a direction."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.filter(F.coalesce((square > 0) & (square < float("inf")), F.lit(False)))  # a null entry makes a null, and NaN is above infinity


def nearest(queries: DataFrame, cache: DataFrame, limit: float, small: int = SMALL, id_column: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """``<id_column>, cached_id, distance`` of each query with a known vector within ``limit``; ids of the cache are whole numbers."""
    if cache.select(F.lit(1)).limit(small + 1).count() <= small:
        return _by_sending(queries, cache, limit, id_column)
    return _by_cells(queries, cache, limit, id_column, block)


def _by_sending(queries: DataFrame, cache: DataFrame, limit: float, id_column: str) -> DataFrame:
    rows = sorted((r[0], list(r[1])) for r in usable(cache.select(id_column, "embedding").filter(f"{id_column} is not null")).collect())
    sent = queries.sparkSession.sparkContext.broadcast(rows)
    id_type = queries.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = units(pa.array([v for _, v in sent.value], pa.list_(pa.float64())))
        ids = np.array([k for k, _ in sent.value], np.int64)[held]
        for batch in batches:
            own, v = units(batch.column(1), known.shape[1])
            if len(own) and len(ids):
                k, far = best(v, known)
                keep = far <= limit
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[keep])), pa.array(ids[k[keep]]), pa.array(np.round(far[keep], 6))], [id_column, "cached_id", "distance"])

    return queries.select(id_column, "embedding").mapInArrow(run, f"{id_column} {id_type}, cached_id bigint, distance double")


def _by_cells(queries: DataFrame, cache: DataFrame, limit: float, id_column: str, block: int) -> DataFrame:
    spark, id_type = queries.sparkSession, queries.schema[id_column].dataType.simpleString()
    known = usable(cache.select(F.col(id_column).cast("bigint").alias("id"), "embedding").filter("id is not null"))
    n, dimension = known.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    known = known.filter(F.size("embedding") == dimension)
    # a sample in a fixed order, about the square root of the collection and at most CENTRES vectors
    some = known.orderBy(F.xxhash64("id"), "id").limit(min(CENTRES, max(1, int(n**0.5)))).collect()
    centres = units(pa.array([list(r["embedding"]) for r in some], pa.list_(pa.float64())), dimension)[1]
    middle = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, v = units(batch.column(1), dimension)
            if len(own) and len(middle.value):
                cell, far = best(v, middle.value)
                kept = [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)).cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(np.maximum(2 * far, 0)))], ["id", "embedding", "cell", "far"])

    dealt = known.mapInArrow(assign, "id bigint, embedding array<double>, cell int, far double")
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).toLocalIterator()}
    # cells in order of their first block; a cell of several blocks has them to itself
    first, parts, radius, at, room = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), np.full(len(centres), -np.inf), -1, 0
    for cell, (size, farthest) in sorted(sizes.items()):
        radius[cell] = farthest
        parts[cell] = -(-size // block)
        if parts[cell] > 1 or size > room or at < 0:
            at, room = at + 1, block
        first[cell] = at
        if parts[cell] > 1:
            at, room = at + int(parts[cell]) - 1, 0
        else:
            room -= size
    plan = spark.sparkContext.broadcast((centres, radius, first, parts))
    reach = (2 * limit) ** 0.5 + 1e-6  # rounding must not pass a cell over

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, first, parts = plan.value
        for batch in batches:
            own, v = units(batch.column(1), dimension)
            if len(own) and len(centres):
                near = np.sqrt(np.maximum(2 - 2 * (v @ centres.T), 0)) - radius <= reach
                blocks = [np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(row)] or [np.zeros(0, np.int64)])) for row in near]
                kept = [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)).cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([b.tolist() for b in blocks], pa.list_(pa.int64()))], ["qid", "embedding", "blocks"])

    asked = queries.select(F.col(id_column).alias("qid"), "embedding").mapInArrow(route, f"qid {id_type}, embedding array<double>, blocks array<bigint>")
    asked = asked.select("qid", "embedding", F.explode("blocks").alias("block"))
    # as many parts for each block as its queries need; what they are dealt by is their vector
    counts = {r["block"]: r["n"] for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    split = {b: -(-n // block) for b, n in counts.items()}
    table = spark.createDataFrame([(int(b), int(s)) for b, s in split.items()] or [(-1, 1)], "block bigint, split bigint")
    asked = asked.join(F.broadcast(table), "block").withColumn("part", F.pmod(F.xxhash64("embedding", "qid"), F.col("split"))).select("block", "part", "qid", "embedding")
    cells = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in sizes] or [(-1, 0, 1)], "cell int, first bigint, parts bigint")
    held = dealt.join(F.broadcast(cells), "cell").select("id", "embedding", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    held = held.join(F.broadcast(table), "block").select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("split") - 1)).alias("part"), "id", "embedding")
    kind = pa.schema([("qid", pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()), ("id", pa.int64()), ("far", pa.float64())])

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("id")
        if not len(asked) or not len(held):
            return kind.empty_table()
        k, far = best(units(asked.column("embedding"), dimension)[1], units(held.column("embedding"), dimension)[1])
        keep = pa.array(far <= limit)
        return pa.Table.from_arrays([asked.column("qid").filter(keep), held.column("id").take(pa.array(k)).filter(keep), pa.array(far).filter(keep)], schema=kind)

    met = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(meet, f"qid {id_type}, id bigint, far double")
    # blocks round alike to 12 digits, so that equally near vectors of two blocks tie
    top = met.groupBy("qid").agg(F.min(F.struct(F.round("far", 12).alias("far"), "id")).alias("b"))
    return top.select(F.col("qid").alias(id_column), F.col("b.id").alias("cached_id"), F.round("b.far", 6).alias("distance"))
