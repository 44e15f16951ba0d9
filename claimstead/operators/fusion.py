"""Rank fusion and merging of candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(hits: DataFrame, by: list[str], k: int, score: str = "score", id_: str = "claim_id") -> DataFrame:
    """The k best hits of each group with their rank from 1; ties go by id."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank_fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, claim_id, score, a component per strategy and route from (query_id, strategy, claim_id, rank[, route]): the sum of 1 / (k + rank).

    A claim that one list has twice adds both, and its component is that of the last; the route is that of the last list (lexical, vector, graph) that has one.
    """
    part = 1 / (F.lit(float(k)) + F.col("rank"))
    component = lambda s: F.max_by(F.when(F.col("strategy") == s, part), F.when(F.col("strategy") == s, F.col("rank"))).alias(f"{s}_component")
    held = lists if "route" in lists.columns else lists.withColumn("route", F.lit(None).cast("string"))
    order = F.when(F.col("route").isNotNull(), F.struct(F.array_position(F.lit(["lexical", "vector", "graph"]), F.col("strategy")).alias("s"), "rank"))
    return held.groupBy("query_id", "claim_id").agg(F.sum(part).alias("score"), component("lexical"), component("vector"), component("graph"), F.max_by("route", order).alias("route"))


def merge_best(hits: DataFrame) -> DataFrame:
    """Per query and claim the hit with the highest score."""
    rest = [c for c in hits.columns if c not in ("query_id", "claim_id", "score")]
    top = hits.groupBy("query_id", "claim_id").agg(F.max(F.struct("score", *rest)).alias("h"))
    return top.select("query_id", "claim_id", "h.*")


def rank_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """query_id, same_order, mismatch: two ranked lists (query_id, rank, claim_id) compared place by place."""
    l_, r = left.select("query_id", "rank", F.col("claim_id").alias("l")), right.select("query_id", "rank", F.col("claim_id").alias("r"))
    both = l_.join(r, ["query_id", "rank"], "full")
    same = F.col("l").eqNullSafe(F.col("r"))
    return both.groupBy("query_id").agg(F.every(same).alias("same_order"), F.avg(F.when(same, 0.0).otherwise(1.0)).alias("mismatch"))


def rerank(hits: DataFrame, order: DataFrame) -> DataFrame:
    """hits in the order of (query_id, claim_id, place); claims the reranker doesn't know are dropped."""
    return hits.join(order, ["query_id", "claim_id"])
