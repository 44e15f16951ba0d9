"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the least node that edges (a, b) reach. Only nodes with an edge to another node are returned.

    Each round links every node's larger neighbours to its least neighbour (large star), then its smaller ones (small star); it
    ends when a round changes nothing. A node's neighbours are never gathered, only their minimum. Rounds are checkpointed.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("x"), F.least("m", "v").alias("m"))
        least = cut(least)  # scans of their own, so that Spark can split the other side where one node has very many neighbours
        large = both.join(least, F.col("v") == F.col("x")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        large = cut(large)
        low = cut(large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "x"))
        joined = large.join(low, F.col("v") == F.col("x"))
        small_star = joined.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        links = cut(small_star)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
