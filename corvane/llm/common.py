"""What the operators share: input tables, durable intermediate tables, word rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words in most operators.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SEED_BUCKETS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``. Only on one machine (tests) is a temporary one made
    where that is unset; executors elsewhere couldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before this process
        pass


_written = threading.local()


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with further options of the writer, and read it back.

    Cuts the lineage durably: a lost executor costs a re-read, not a
    recomputation of everything before. The files go with ``release``, at the end
    of the ``scratch`` block they were written in, or else when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    atexit.register(drop_path, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    for block in getattr(_written, "blocks", ()):
        block.append(path)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t._written_to)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes all tables written inside when the block ends; paths taken off the list stay."""
    blocks = _written.blocks = getattr(_written, "blocks", [])
    paths: list[str] = []
    blocks.append(paths)
    try:
        yield paths
    finally:
        blocks.remove(paths)
        for p in paths:
            drop_path(spark, p)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores after it while a column is called so, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def _is_file_table(docs: DataFrame) -> bool:
    """Whether the frame is a table of files, at most with rows or columns left out: each of its rows is one row of a file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and "_metadata" in plan.metadataOutput().toString()


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that tells its rows apart and is the same in every reading.

    Rows of a file table are known by their file and their place in it; any other
    frame is written once with a generated number.
    """
    if "_metadata" not in (c.lower() for c in docs.columns) and _is_file_table(docs):
        return docs.select("*", F.concat_ws(":", F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")).alias(name))
    return materialize(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "keyed")


PLACE_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def running_sums(df: DataFrame, order: list, sums: dict[str, Column], label: str) -> DataFrame:
    """Adds for each name the sum of its column over all rows that come before in the global order.

    Two levels: rows are dealt by ranges of the order and summed inside them, and each
    range starts where the ranges before it end; no task gets all rows.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumns({f"_own_{n}": c.cast("long") for n, c in sums.items()})
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.call_function("shiftright", F.col("_at"), F.lit(PLACE_BITS))), label)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(*[F.sum(f"_own_{n}").alias(n) for n in sums])
    # one row for each range, at most `parts`
    starts = F.broadcast(starts.select(F.col("_part").alias("_range"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_start_{n}") for n in sums]))
    rows = placed.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_own_{n}").over(inside), F.lit(0)) for n in sums})
    rows = rows.join(starts, F.col("_part") == F.col("_range"))
    return rows.select(*df.columns, *[(F.col(f"_start_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])


FREQUENT = 200


def join_by_count(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group. ``groups`` is a written table of one row
    for each key, with the number of its rows in the column ``size``.

    Groups of more than a share of 1 in ``FREQUENT`` of all rows number less than
    ``FREQUENT``, whatever the input; they are broadcast and their rows stay where they
    are. All others meet in a sort-merge join in which no key is frequent.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    often = groups.filter(F.col(size) > max(total // FREQUENT, 1))
    hot = F.broadcast(often)
    if often.isEmpty():
        return rows.join(groups.hint("merge"), key)
    rare = groups.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rare.hint("merge"), key))


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null has none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def count_space_words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_RUN))).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % SEED_BUCKETS == 0, F.lit(False))


def sha256_utf8(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
