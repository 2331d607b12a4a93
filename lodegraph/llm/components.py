"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two pre-aggregated minima and two joins that adaptive execution can split at hubs; rounds grow with the
logarithm of the longest chain. Nothing is gathered at the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, left: str = "u", right: str = "w") -> DataFrame:
    """(v, root) for every linked v that is not itself its component's least: root is that least one.

    Self-links and repeated links do no harm; no links give an empty table.
    """
    edges = links.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a < b").distinct()
    edges, before, step = scratch.save(edges, "edges0"), None, 0
    while True:
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x"), F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("m").alias("a"), F.col("y").alias("b")).distinct()
        large = scratch.save(large, f"large{step}")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(down, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        step += 1
        edges = scratch.save(moved.unionByName(down.select(F.col("m").alias("a"), "b")).distinct(), f"edges{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("b").alias("v"), F.col("a").alias("root"))
