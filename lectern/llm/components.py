"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations and joins; no node's neighbours are ever gathered, and nothing
but one pair of numbers for each round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, kept


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``links`` but the roots.

    Repeated links count once, in either direction, and a link of a node with itself not at all;
    no links, no rows. A link without one of its ends is none. Other columns are not looked at.
    """
    whole = F.col(a).isNotNull() & F.col(b).isNotNull()
    edges = kept(links.where(whole).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        seen = Observation()
        digest = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        old, edges = edges, kept(small.where("u <> v").distinct().observe(seen, *digest), "small-star")
        discard(old, large)
        if seen.get == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen.get
