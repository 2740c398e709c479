"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _nearest(edges: DataFrame) -> DataFrame:
    """For every node its smallest neighbour, itself included; summed in each task before anything is sent."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v: numbers), root being the smallest node it can reach.

    Alternates large-star (each node hands its larger neighbours to its smallest) and small-star (each node hands its
    smaller neighbours to its smallest) until the links are stars, a number of rounds logarithmic in the longest
    chain. Joins on a hot node are split by adaptive execution.
    """
    links = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_nearest(large), "u").select("u", "v", "m")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        links = written(small, "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
