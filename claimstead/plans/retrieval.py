"""Hybrid retrieval for a batch of queries: candidates, fusion, suppression, access, budget, receipts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.scope import access_reason
from claimstead.functions.text import explain_hit
from claimstead.operators import access, lexical_index
from claimstead.operators.fusion import reciprocal_rank_fuse, rerank, top_k
from claimstead.operators.graph import graph_hits, seed_entities
from claimstead.operators.identity import settle
from claimstead.operators.perspective import QUESTION
from claimstead.operators.search import lexical_top_k, vector_top_k


@dataclass(frozen=True)
class Plan:
    """Limits of a retrieval. Defaults are the public ones of the service this library stands in for."""

    lexical: int = 30
    vector: int = 50
    hops: int = 2
    budget: int = 20
    k: int = 60
    least_similarity: float = 0.15

    @property
    def graph(self) -> int:
        """Candidates of the graph at most."""
        return max(2 * self.budget, 20)


#: Fixed value: what receipts name the plan by.
PLAN_VERSION = "retrieval-v2"


def scoped(questions: DataFrame) -> DataFrame | None:
    """The questions, if they have a perspective (perspective.asked); else None, and every question is answered from all claims."""
    return questions if set(QUESTION) <= set(questions.columns) else None


def candidates(strategy: str, queries: DataFrame, texts: DataFrame, vectors: DataFrame, edges: DataFrame | None, seeds: DataFrame | None, plan: Plan) -> DataFrame:
    """One signature for every strategy: query_id, claim_id, score, rank. Questions with a perspective get candidates from it alone, before the limit. texts may be a kept index (lexical_index) instead, which is read without their texts."""
    if strategy == "lexical":
        return (lexical_index.lexical_top_k if "runs" in texts.columns else lexical_top_k)(queries, texts, plan.lexical)
    if strategy == "vector":
        return vector_top_k(queries, vectors, plan.vector, plan.least_similarity)
    if strategy == "graph" and edges is not None and seeds is not None:
        return top_k(graph_hits(seeds, edges, plan.hops, limit=plan.graph, questions=scoped(queries)), ["query_id"], plan.graph)
    raise ValueError(f"unknown strategy {strategy}")


def additive(queries: DataFrame, texts: DataFrame, vectors: DataFrame, plan: Plan, edges: DataFrame | None = None) -> DataFrame:
    """query_id, claim_id, score, components, route: lexical and vector scores added, then the neighbourhood of those hits.

    edges: claim_id, subject_id, object_entity_id. A claim within plan.hops of a hit's ends that isn't hit itself gets .3 / hop and its subject for route.
    Questions may have a perspective (perspective.asked); texts, vectors and edges then have its columns (perspective.CLAIM), none of them retracted.
    """
    lex = settle(candidates("lexical", queries, texts, vectors, None, None, plan).select("query_id", "claim_id", F.col("score").cast("double").alias("lexical")))
    vec = settle(candidates("vector", queries, texts, vectors, None, None, plan).select("query_id", "claim_id", F.col("score").alias("vector")))
    both = lex.join(vec, ["query_id", "claim_id"], "full")
    both = both.withColumn("score", F.round(F.coalesce("lexical", F.lit(0.0)) + F.coalesce("vector", F.lit(0.0)), 6))
    if edges is None or plan.hops < 1:
        return both.withColumns({"graph": F.lit(None).cast("double"), "route": F.lit(None).cast("string")})
    both = settle(both)
    near = graph_hits(seed_entities(both, edges), edges, plan.hops, "expansion", "subject", questions=scoped(queries)).join(both, ["query_id", "claim_id"], "left_anti")
    near = near.select("query_id", "claim_id", F.round("score", 6).alias("score"), F.col("score").alias("graph"), "route")
    return both.unionByName(near, allowMissingColumns=True)


def fused(queries: DataFrame, texts: DataFrame, vectors: DataFrame, plan: Plan, edges: DataFrame | None = None) -> DataFrame:
    """query_id, claim_id, score, components, route: the lists' reciprocal ranks added. The graph's list starts from the ends of the other lists' claims, which it leaves out. Perspectives as in additive."""
    # each list is written by itself: a few rows a question, which what follows reads more than once
    lex, vec = (settle(candidates(s, queries, texts, vectors, None, None, plan).select("query_id", F.lit(s).alias("strategy"), "claim_id", "rank")) for s in ("lexical", "vector"))
    lists = lex.unionByName(vec).withColumn("route", F.lit(None).cast("string"))
    if edges is not None and plan.hops > 0:
        # a query has at most plan.lexical + plan.vector seed claims, all of which the graph may find before others
        near = graph_hits(seed_entities(lists, edges), edges, plan.hops, limit=plan.graph + plan.lexical + plan.vector, questions=scoped(queries))
        near = top_k(near.join(lists.select("query_id", "claim_id").distinct(), ["query_id", "claim_id"], "left_anti"), ["query_id"], plan.graph)
        lists = lists.unionByName(near.select("query_id", F.lit("graph").alias("strategy"), "claim_id", "rank", "route"))
    return reciprocal_rank_fuse(lists, plan.k)


def answer(hits: DataFrame, claims: DataFrame, questions: DataFrame, now: Column, plan: Plan, suppressed: DataFrame | None = None, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked hits that each question's own reader may see, omissions per query and classification, and an access receipt for every hit that was judged, denied ones too.

    questions: query_id, reader, and purpose and delegation where they count. Hits without a claim are dropped, suppressed claims of the reader's tenant silently,
    without a receipt. order: a reranker's (query_id, claim_id, place).
    """
    found = hits.join(claims, "claim_id")
    asking = questions.select(
        "query_id", F.col("reader").alias("_reader"), (F.col("purpose") if "purpose" in questions.columns else F.lit(None).cast("string")).alias("_purpose"),
        (F.col("delegation") if "delegation" in questions.columns else F.lit(None)).cast(access.DELEGATION).alias("_given"),
    )
    found = found.join(asking, "query_id")
    if suppressed is not None:
        gone = suppressed.withColumnsRenamed({c: f"_s_{c}" for c in suppressed.columns})
        same = [F.col("claim_id") == F.col("_s_claim_id")] + ([F.col("_reader.tenant_id") == F.col("_s_tenant_id")] if "tenant_id" in suppressed.columns else [])
        found = found.join(gone, same, "left_anti")
    resource = F.struct("tenant_id", "namespace_id", "classification", "visibility", "owner_id")
    given = F.struct(F.col("_reader.tenant_id").alias("tenant_id"), now.alias("now"), F.col("_purpose").alias("purpose"), F.col("_given").alias("delegation"))
    decided = found.withColumn("reason", access_reason(F.col("_reader"), F.lit("knowledge.read"), resource, given)).withColumn("principal_id", F.col("_reader.principal_id"))
    decided = settle(decided.drop("_reader", "_purpose", "_given"))
    allow = access.receipts(decided, "knowledge.read", "claim", "claim_id", now, also=["query_id"])
    seen = decided.where("reason = 'ALLOW'")
    if order is not None:
        seen = rerank(seen, order).withColumn("score", -F.col("place").cast("double")).drop("place")
    return top_k(seen, ["query_id"], plan.budget), access.omissions(decided, "query_id"), allow


def receipts(ranked: DataFrame, omitted: DataFrame, questions: DataFrame, allow: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """A receipt per question: who asked in which scope, at which instants and for what, the hash of the text, the plan, the selected claims with reasons, components and evidence, what was left out, and every access decision.

    allow: access receipts of answer; evidence: claim_id, evidence_id. What questions don't have is null.
    """
    reason = explain_hit(F.col("lexical"), F.col("vector"), F.col("graph")) if "vector" in ranked.columns else F.lit("metadata match")
    parts = [c for c in ("lexical", "vector", "graph", "lexical_component", "vector_component", "graph_component") if c in ranked.columns]
    proof = ranked.select("query_id", "claim_id").join(evidence, "claim_id").groupBy("query_id", "claim_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids")) if evidence is not None else None
    shown = ranked.withColumn("evidence_ids", F.array().cast("array<string>")) if proof is None else ranked.join(proof, ["query_id", "claim_id"], "left")
    shown = shown.withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    chosen = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "claim_id", "score", reason.alias("reason"), "evidence_ids", *parts))).alias("selected"))
    left = omitted.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("classification", "omitted"))).alias("omissions"))
    has = lambda c, t: F.col(c) if c in questions.columns else F.lit(None).cast(t)
    who = F.col("reader.principal_id") if "reader" in questions.columns else F.lit(None).cast("string")
    found = questions.select(
        "query_id", F.sha2("text", 256).alias("query_hash"), who.alias("principal_id"), has("tenant_id", "string").alias("tenant_id"), has("namespace_id", "string").alias("namespace_id"), F.lit("internal").alias("classification"),
        F.lit("workspace").alias("visibility"), has("purpose", "string").alias("purpose"), F.array_compact(F.array(has("purpose", "string"))).alias("policy_tags"), has("valid_at", "timestamp_ntz").alias("valid_at"), has("known_at", "timestamp_ntz").alias("known_at"), F.lit(PLAN_VERSION).alias("plan_version"),
    )
    found = found.join(chosen, "query_id", "left").join(left, "query_id", "left")
    if allow is None:
        return found
    told = allow.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("resource_id", "effect", "reason", "action", "resource_kind", "evaluated_at"))).alias("authorizations"))
    return found.join(told, "query_id", "left")
