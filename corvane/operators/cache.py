"""Response and vector caches as batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions.dialect import double_sum, strip
from corvane.operators.decide import severity_name, severity_rank
from corvane.operators.vector_index import SMALL, nearest

TTL_SECONDS = 300
SIMILAR_LENGTH = 40


def exact_key(text: Column, target: Column, profile: Column, workspace: Column) -> Column:
    return F.md5(F.concat_ws(":", target, profile, workspace, strip(text)).cast("binary"))


def similar_key(text: Column, target: Column, profile: Column, workspace: Column) -> Column:
    """Key of the collapsed lower-case text; null for short texts."""
    plain = F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))
    return F.when(F.length(plain) >= SIMILAR_LENGTH, F.md5(F.concat_ws(":", target, profile, workspace, plain).cast("binary")))


def distinct_requests(texts: DataFrame, key: Column, order: str) -> DataFrame:
    """One row for each key, the first, with the number of requests it answers: score these, join back."""
    d = texts.withColumn("_key", key)
    return d.groupBy("_key").agg(F.min(F.col(order)).alias(order), F.count(F.lit(1)).alias("requests")).withColumnRenamed("_key", "cache_key")


def ttl_hits(requests: DataFrame, key: str, at: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Hits and misses of each key when an entry lives ``ttl`` seconds from its insertion and hits don't renew it.

    Times are pre-aggregated to one for each distinct second, dealt by key and sorted; a task folds over its
    keys' seconds as they stream by and holds none of them.
    """
    seconds = F.unix_seconds(F.col(at).cast("timestamp")).cast("bigint")
    kind = requests.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, since, misses, hits, out = None, True, 0, 0, 0, []
        names, kinds = [key, "misses", "hits"], None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for k, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or k != now:
                    out += [] if first else [(now, misses, hits)]
                    now, first, since, misses, hits = k, False, None, 0, 0
                if since is None or s is None or s - since >= ttl:
                    since, misses, hits = s, misses + 1, hits + n - 1
                else:
                    hits += n
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kinds, pa.int64(), pa.int64()), strict=True)], names)
                out = []
        out += [] if first else [(now, misses, hits)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kinds, pa.int64(), pa.int64()), strict=True)], names)

    d = requests.groupBy(key, seconds.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return d.repartition(key).sortWithinPartitions(key, "_s").mapInArrow(fold, f"{key} {kind}, misses bigint, hits bigint")


def dot(a: Column, b: Column) -> Column:
    return double_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def newest(entries: DataFrame, most: int = 500) -> DataFrame:
    """What a first-in-first-out cache still holds: the last ``most`` insertions."""
    return entries.orderBy(F.desc("inserted"), F.desc("cache_key")).limit(most)


#: Fixed values. Distances within which a text counts as a known threat, and as known to be safe.
THREAT_DISTANCE, ALLOW_DISTANCE = 0.15, 0.10


def recalled(texts: DataFrame, threats: DataFrame, allowed: DataFrame, id_column: str = "vec_id", small: int = SMALL) -> DataFrame:
    """Adds ``allow_reason`` and ``cached_threat`` (threat_type, severity, similarity, source), null where no
    known vector is near; ``decide`` takes both into account, the allowlist first.

    ``texts`` have ``embedding``; each row keeps its columns and comes once, whatever ids repeat, since rows
    get their answer by their vector. ``threats`` have ``id_column``, threat_type, severity and source_agent,
    ``allowed`` a reason. Where a cache has an id more than once, as texts do that two detectors taught, the most
    severe threat counts, and the least reason.
    """
    look = fresh(texts.columns, "_vector")
    keyed = texts.withColumn(look, F.sha2(F.array_join(F.transform("embedding", lambda x: F.coalesce(x.cast("double").cast("string"), F.lit("null"))), ","), 256))
    asked = keyed.filter(F.col(look).isNotNull()).groupBy(F.col(look).alias(id_column)).agg(F.first("embedding").alias("embedding"))
    safe = nearest(asked, allowed, ALLOW_DISTANCE, small, id_column).select(F.col(id_column).alias("_k"), F.col("cached_id").alias("_safe"))
    bad = nearest(asked, threats, THREAT_DISTANCE, small, id_column).select(F.col(id_column).alias("_k"), F.col("cached_id").alias("_bad"), F.col("distance").alias("_far"))
    reasons = allowed.groupBy(F.col(id_column).alias("_safe")).agg(F.min("reason").alias("_reason"))
    worst = F.max(F.struct(severity_rank(F.col("severity")).alias("rank"), "threat_type", "severity", "source_agent")).alias("k")
    kinds = threats.groupBy(F.col(id_column).alias("_bad")).agg(worst)
    threat = F.struct(F.col("k.threat_type").alias("threat_type"), F.col("k.severity").alias("severity"), F.round(1 - F.col("_far"), 2).alias("similarity"), F.col("k.source_agent").alias("source"))
    known = bad.join(kinds, "_bad").select("_k", threat.alias("_threat")).join(safe.join(reasons, "_safe").select("_k", "_reason"), "_k", "full_outer")
    d = keyed.join(known, F.col(look) == F.col("_k"), "left")
    return d.select(*texts.columns, F.col("_reason").alias("allow_reason"), F.when(F.col("_reason").isNull(), F.col("_threat")).alias("cached_threat"))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores after it while a column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def learned(decisions: DataFrame, *columns: str) -> DataFrame:
    """Rows that the threat cache takes from decisions: findings of the model-backed detectors, with
    the given columns of their texts. A stream appends them batch by batch."""
    hits = F.filter("agents", lambda a: a["threat_found"] & a["agent"].isin(*C.MODEL_BACKED) & (a["threat_type"] != "NONE"))
    d = decisions.select(*columns, F.explode(hits).alias("_a"))
    return d.select(*columns, F.col("_a.threat_type").alias("threat_type"), severity_name(F.col("_a.severity")).alias("severity"), F.col("_a.agent").alias("source_agent"))
