"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import pin


def components(links: DataFrame) -> DataFrame:
    """Rows node, component of all nodes of `links` (a, b: bigint); component is the smallest node reached.

    Stars are turned in two steps until nothing changes: every node's larger neighbours are linked to
    the smallest of its neighbourhood, then every node with its smaller neighbours likewise. Each
    step is an aggregation with map-side minima and a join that adaptive execution can split, so a
    node with very many links is no single task. Rounds are cut by reliable checkpoints. Nulls and
    loops are ignored, repeated links count once.
    """
    proper = links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    stars = pin(proper.distinct())
    seen = _mark(stars)
    while seen[0]:
        both = stars.union(stars.select(F.col("high").alias("low"), F.col("low").alias("high")))
        smallest = both.groupBy("low").agg(F.min("high").alias("near")).select("low", F.least("low", "near").alias("least"))
        larger = both.where("high > low").join(smallest, "low").select(F.col("least").alias("low"), "high").distinct()
        smallest = larger.groupBy("high").agg(F.min("low").alias("least"))
        pulled = larger.join(smallest, "high").where("low <> least").select(F.col("least").alias("low"), F.col("low").alias("high"))
        stars = pin(pulled.union(smallest.select(F.col("least").alias("low"), "high")).distinct())
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    leaves = stars.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return leaves.union(stars.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())


def _mark(stars: DataFrame) -> tuple:
    """Row count and order-free digest of the links."""
    row = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
    return row[0], row[1]
