"""Connected components of links between integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import kept


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` for every node with a link to another; ``root`` is the smallest node it reaches.

    Large stars and small stars in turn: each step links a node's neighbours to their smallest. Steps
    grow with the logarithm of the longest path, and each is written, so that no lineage builds up. A
    node's minimum is aggregated before the shuffle; its links are joined, never gathered.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    edges = kept(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while (now := _sum(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.distinct(), "large_star")
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "small_star")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
