"""Connected components of links that stay distributed: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Ties each node's neighbours to the least node around it: those above it, or those not above it."""
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    pairs = links.join(least, "a")
    if large:
        pairs = pairs.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return pairs.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); the root is the least node of its component.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    now = materialize(links.filter("a <> b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        before, now = now, materialize(_star(_star(now, True), False), "links")
        release(before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
