"""Exact deduplication with a persistent digest index.

The index is a table of one row for each distinct text: its SHA-256 digest and the row
that stays for it. It is bucketed by the digest and sorted inside each bucket, so a
batch of new documents meets it in a sort-merge anti-join for which only the batch is
shuffled; the digests that the anti-join leaves are appended. An entry never changes:
whoever came first stays. ``DigestIndex.create`` makes an index, ``DigestIndex.open``
finds one that an earlier session wrote, and ``admit`` takes a batch in.

Equal texts are grouped by digest before any shuffle, so a group of a third of all rows
is one row for each task. Rows get their group's result back by ``join_by_count``.

A batch that is added twice adds nothing the second time. Tasks that are lost are run
again, and files of an append that did not end are not part of the table.

Edge cases: a null text counts as the empty one; of equal texts in one batch the row
with the largest ``doc_id`` stays, rows without an id come last, and of rows that tie
one stays; repeated rows each get their result; a very long text is read whole; an
empty table adds nothing and gives no rows; extra columns are carried by ``admitted``
whatever their names.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import drop_path, fresh, join_by_count, materialize, shared_dir, with_row_key

DIGEST = "digest"


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """``doc_id, digest, at`` and the carried columns for each row, written once; ``at`` tells rows apart."""
    rows = docs.select("doc_id", digest(F.col("text")).alias(DIGEST), *carry)
    return materialize(rows.withColumn("at", F.monotonically_increasing_id()), "digests")


def grouped(prints: DataFrame) -> DataFrame:
    """``digest, keep_id, keep_at, group_size`` for each text of a batch, written once.

    It is written because the optimizer would push an anti-join below the grouping, and
    shuffle each row of a large group.
    """
    texts = prints.groupBy(DIGEST).agg(F.max(F.struct("doc_id", "at")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return materialize(texts.select(DIGEST, F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("keep_at"), "group_size"), "texts")


@dataclass(frozen=True)
class DigestIndex:
    """A table ``digest, keep_id, keep_at, batch`` of distinct texts, bucketed and sorted by digest."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    @staticmethod
    def create(spark: SparkSession, doc_id_type: str, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """An empty index at ``path``, or in the shared folder until the process ends.

        ``buckets`` stays for the life of the index: about 1 GB of entries each is a good
        size; by default as many as the session has shuffle partitions.
        """
        at = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        index = DigestIndex.open(spark, doc_id_type, at, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        if path is None:
            atexit.register(index.forget)
        return index

    def forget(self) -> None:
        """Deletes the index, its files too."""
        with contextlib.suppress(Exception):  # the session may have ended before this process
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_path(self.spark, self.path)

    @staticmethod
    def open(spark: SparkSession, doc_id_type: str, path: str, buckets: int) -> DigestIndex:
        """The index whose files are at ``path``; type and buckets are those that it was made with."""
        name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({DIGEST} BINARY, keep_id {doc_id_type}, keep_at BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return DigestIndex(spark, name, path, buckets)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, texts: DataFrame) -> DataFrame:
        """Those of the grouped texts that the index lacks, by a sort-merge anti-join."""
        return texts.join(self.entries().select(DIGEST).hint("merge"), DIGEST, "left_anti")

    def add(self, texts: DataFrame) -> str:
        """Appends what is new in a batch of grouped texts; returns the name that its entries carry."""
        batch = uuid.uuid4().hex
        new = self.unseen(texts).select(DIGEST, "keep_id", "keep_at", F.lit(batch).alias("batch"))
        new.write.mode("append").format("parquet").option("compression", "zstd").bucketBy(self.buckets, DIGEST).sortBy(DIGEST).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        return batch

    def admitted(self, docs: DataFrame) -> DataFrame:
        """Adds ``docs`` to the index and returns its rows that stay, with all their columns."""
        key = fresh(docs.columns, "_key")
        rows = with_row_key(docs, key)
        plain = rows.select(F.col("doc_id"), F.col("text"), F.col(key).alias("row_key"))
        prints = fingerprints(plain, "row_key")
        batch = self.add(grouped(prints))
        stay = self.entries().filter(F.col("batch") == batch).select(F.col(DIGEST), F.col("keep_at").alias("at"))
        kept = prints.join(stay, [DIGEST, "at"], "left_semi").select(F.col("row_key").alias(key))
        return rows.join(kept, key, "left_semi").select(*docs.columns)


def membership(prints: DataFrame, texts: list[DataFrame], index: DigestIndex, added: list[str]) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for each row, after the grouped ``texts`` of ``prints`` came in as the batches ``added``.

    The group's size counts the rows of ``prints``; a row whose text an earlier batch
    brought isn't kept, and its ``keep_id`` is that earlier row's.
    """
    every = texts[0]
    for t in texts[1:]:
        every = every.unionByName(t)
    sizes = every.groupBy(DIGEST).agg(F.sum("group_size").alias("group_size"))
    entries = index.entries().select(DIGEST, "keep_id", F.when(F.col("batch").isin(added), F.col("keep_at")).alias("keep_at"))
    groups = materialize(sizes.join(entries.hint("merge"), DIGEST), "groups")
    found = join_by_count(prints, groups, DIGEST, "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("at") == F.col("keep_at"), F.lit(False)).alias("kept"), DIGEST)


def deduplicate(docs: DataFrame, arrivals: int = 2, index: DigestIndex | None = None) -> DataFrame:
    """``membership`` of a whole table whose rows arrive in descending order of ``doc_id``, in ``arrivals`` batches.

    So the largest id of equal texts is in the index before any other, and later batches
    are anti-joined with what earlier ones appended. Rows without an id come last.
    """
    prints = fingerprints(docs)
    index = index or DigestIndex.create(docs.sparkSession, docs.schema["doc_id"].dataType.simpleString())
    texts = [grouped(batch) for batch in batches(prints, arrivals)]
    return membership(prints, texts, index, [index.add(t) for t in texts])


def batches(prints: DataFrame, n: int) -> list[DataFrame]:
    """About equal parts by descending id; the cuts are sketched, and where they fall changes no result."""
    if n < 2 or prints.schema["doc_id"].dataType.simpleString() not in ("bigint", "int"):
        return [prints]
    cuts = prints.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)])).first()[0] or []
    out, above = [], None
    for cut in sorted(set(cuts), reverse=True):
        out.append(prints.filter(F.col("doc_id") >= cut) if above is None else prints.filter((F.col("doc_id") >= cut) & (F.col("doc_id") < above)))
        above = cut
    return [*out, prints if above is None else prints.filter(F.col("doc_id").isNull() | (F.col("doc_id") < above))]
