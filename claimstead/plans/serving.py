"""Answering from the projection's indexes where they are ready, and from the claims themselves where they aren't, question by question."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.operators.fusion import top_k
from claimstead.operators.identity import settle, small
from claimstead.operators.search import lexical_top_k, vector_top_k
from claimstead.operators.lexical_index import lexical_top_k as indexed_lexical
from claimstead.operators.vector_graph import graph_top_k
from claimstead.plans.retrieval import Plan
from claimstead.sources.sinks import RELEVANT


@dataclass(frozen=True)
class Indexes:
    """A projection's kept indexes: lexical segments and vector graphs, and the catalogue: tenant_id, indexed_at, the instant up to which a tenant's events are in them."""

    segments: DataFrame
    graphs: DataFrame
    catalogue: DataFrame


def freshness(catalogue: DataFrame, events: DataFrame, now: Column, max_lag_ms: int = 30_000) -> DataFrame:
    """tenant_id, lag_ms, ready for each tenant of the catalogue: the age of the newest relevant event that isn't in the index. events: tenant_id, kind, occurred_at. A tenant's events are reduced before they are joined."""
    newest = events.where(F.col("kind").isin(RELEVANT)).groupBy("tenant_id").agg(F.max("occurred_at").alias("newest"))
    late = F.coalesce(F.col("newest") > F.col("indexed_at"), F.lit(False))
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 1000)
    lag = F.when(late, F.greatest(age, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return catalogue.join(newest, "tenant_id", "left").select("tenant_id", lag.alias("lag_ms"), (lag <= max_lag_ms).alias("ready"))


def routed(questions: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """questions with route, projection or canonical, and the reason of a fallback: missing-index, stale, or known-at, as indexes hold what is known now."""
    beside = questions.withColumn("_ready", F.lit(None).cast("boolean")) if fresh is None else questions.join(small(fresh.select("tenant_id", F.col("ready").alias("_ready"))), "tenant_id", "left")
    reason = F.when(F.col("_ready").isNull(), "missing-index").when(~F.col("_ready"), "stale").when(F.col("known_at").isNotNull(), "known-at")
    return beside.withColumn("fallback", reason).withColumn("route", F.when(F.col("fallback").isNull(), "projection").otherwise("canonical")).drop("_ready")


def candidates(strategy: str, questions: DataFrame, indexes: Indexes | None, texts: DataFrame, vectors: DataFrame, plan: Plan) -> DataFrame:
    """query_id, claim_id, score, rank, route of routed questions that have a perspective: each route answers its own questions, and one without questions reads nothing.

    lexical gives the same rows on either route; vector is approximate on the projection's (vector_graph) and exact on the other.
    """
    if strategy not in ("lexical", "vector"):
        raise ValueError(f"unknown strategy {strategy}")
    questions = settle(questions)
    found = []
    for route in ("projection", "canonical"):
        own = questions.where(F.col("route") == route).drop("route", "fallback")
        if own.isEmpty():
            continue
        if route == "projection":
            hits = indexed_lexical(own, indexes.segments, plan.lexical) if strategy == "lexical" else top_k(graph_top_k(indexes.graphs, own, plan.vector, max(plan.vector, 64), plan.least_similarity).drop("rank"), ["query_id"], plan.vector)
        else:
            hits = lexical_top_k(own, texts, plan.lexical) if strategy == "lexical" else vector_top_k(own, vectors, plan.vector, plan.least_similarity)
        found.append(hits.select("query_id", "claim_id", "score", "rank", F.lit(route).alias("route")))
    if not found:
        return lexical_top_k(questions.drop("route", "fallback"), texts, plan.lexical).select("query_id", "claim_id", "score", "rank", F.lit("").alias("route"))
    return found[0] if len(found) == 1 else settle(found[0]).unionByName(settle(found[1]))


def rates(log: DataFrame) -> DataFrame:
    """requests, fallbacks, fallback_rate over routed questions; a rate of 0 without any."""
    lost = F.sum(F.when(F.col("route") == "canonical", 1).otherwise(0))
    return log.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(lost, F.lit(0)).alias("fallbacks"), F.coalesce(lost / F.count(F.lit(1)), F.lit(0.0)).alias("fallback_rate"))
