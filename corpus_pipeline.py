"""A training corpus from raw documents, in five stages of the ``corvane.llm`` operators.

Each stage gets all rows that the one before kept, as a table in the shared folder,
and returns the columns of that table; the last adds each row's shard and slot.
Stages tell rows apart by a key of their own (a row's place in the files of its
table), so that repeated ids and rows without a ``doc_id`` are judged like all
others. Extra columns are carried unchanged, whatever their names: a result column
whose name is taken gets underscores after it.

Edge cases: a null text, or one without a letter, is rejected by language ID; of
equal and near-equal texts one row stays; a very long text is read whole by each
stage; ties are settled as the operators' docstrings say; empty tables pass through
all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, language, mixing, near_duplicates, sharding
from corvane.llm.common import fresh, materialize, scratch, table, with_row_key


def by_key(docs: DataFrame, key: str) -> DataFrame:
    """Narrow rows for an operator that is to refer to rows by their key."""
    return docs.select(F.col(key).alias("doc_id"), "text")


def with_stand_in(docs: DataFrame) -> DataFrame:
    """Rows without an id get a hash of their text for it, for operators that shuffle or sample by id."""
    hashed = F.xxhash64("text")
    return docs.withColumn("doc_id", F.coalesce("doc_id", hashed.cast("string") if docs.schema["doc_id"].dataType.simpleString() == "string" else hashed))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told."""
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    found = language.identify(docs, language.learn(with_stand_in(docs)), results=(lang, score))
    return found.filter(F.col(lang) != language.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least id stays; rows without an id come last."""
    key = fresh(docs.columns, "_key")
    rows = with_row_key(docs, key)
    classes = near_duplicates.join(by_key(rows, key)).select(F.col("doc_id").alias("k"), "class_id")
    ranks = rows.select(F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(key).alias("k")).alias("rank"))
    first = ranks.join(classes, F.col("rank.k") == F.col("k")).groupBy("class_id").agg(F.min("rank").alias("rank"))
    return rows.join(first.select(F.col("rank.k").alias(key)), key, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold too much of a benchmark item."""
    key = fresh(docs.columns, "_key")
    rows = with_row_key(docs, key)
    hits = decontamination.search(decontamination.build_index(by_key(rows, key)), table(spark, sf_dir, "benchmark"))
    bad = hits.filter(decontamination.contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("doc_id").alias(key))
    return rows.join(bad, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    key, times, copy = (fresh(docs.columns, n) for n in ("_key", "_times", "_copy"))
    rows = with_row_key(docs, key)
    mix = mixing.fair_mix(with_stand_in(rows.select(F.col(key).alias("row_key"), "doc_id", "text", "source")), carry=("row_key",))
    mix = mix.filter("taken > 0").select(F.col("row_key").alias(key), (F.col("taken") / F.col("size")).cast("int").alias(times))
    return rows.join(mix, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot``."""
    return sharding.sharded(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express language ID by profiles; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        # what a stage and the one before it wrote goes once its result is written
        with scratch(spark) as paths:
            if k:
                paths.append(docs._written_to)
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            paths.remove(docs._written_to)
    return docs
