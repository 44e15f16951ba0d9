"""Neighbourhoods in the graph whose nodes are entities and whose edges are claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.operators.identity import settle
from claimstead.operators.perspective import CLAIM, QUESTION, seen as in_perspective


def endpoints(edges: DataFrame) -> DataFrame:
    """A row per end of each edge, so that a hop is an equi-join: entity, claim_id, other, subject_id, and what edges have of a claim's place and time."""
    also = [c for c in CLAIM if c in edges.columns]
    far = edges.select(F.col("subject_id").alias("entity"), "claim_id", F.col("object_entity_id").alias("other"), "subject_id", *also)
    near = edges.where("object_entity_id IS NOT NULL").select(F.col("object_entity_id").alias("entity"), "claim_id", F.col("subject_id").alias("other"), "subject_id", *also)
    return far.unionByName(near)


def hubs(edges: DataFrame, degree: int) -> DataFrame:
    """entity, claims of entities with over `degree` claims: what a frontier that reaches them grows by."""
    return endpoints(edges).groupBy("entity").agg(F.count(F.lit(1)).alias("claims")).where(F.col("claims") > degree)


def seed_entities(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, entity: both ends of the claims that a query hit."""
    ends = hits.select("query_id", "claim_id").join(edges.select("claim_id", F.explode(F.array("subject_id", "object_entity_id")).alias("entity")), "claim_id")
    return ends.where("entity IS NOT NULL").select("query_id", "entity").distinct()


def graph_hits(seeds: DataFrame, edges: DataFrame, hops: int, scoring: str = "inverse", route: str = "frontier", limit: int | None = None, questions: DataFrame | None = None) -> DataFrame:
    """query_id, claim_id, hop, score, route for claims within `hops` of a query's seed entities, each at its first hop.

    A query that has `limit` claims after a hop isn't taken further: later claims rank behind those.

    scoring: 'inverse' gives 1 / hop, 'expansion' 0.3 / hop. route: the least frontier entity that led to the claim, or its
    subject. Frontiers hold entities seen for the first time; every hop is checkpointed. questions (query_id, perspective): a question's hops then go over the
    claims of its perspective alone.
    """
    ends = endpoints(edges)
    asked = None if questions is None else settle(questions.select("query_id", *QUESTION))

    def reached(frontier_: DataFrame) -> DataFrame:
        columns = ["query_id", "claim_id", "entity", "other", "subject_id"]
        if asked is None:
            return frontier_.join(ends, "entity").select(columns)
        q, e = frontier_.join(asked, "query_id").alias("q"), ends.alias("e")
        met = q.join(e, (F.col("q.entity") == F.col("e.entity")) & in_perspective("e", "q"))
        return met.select(*[F.col(f"{"q" if c == "query_id" else "e"}.{c}").alias(c) for c in columns])

    seen = settle(seeds.select("query_id", "entity").distinct())
    frontier, found = seen, None
    for hop in range(1, hops + 1):
        step = settle(reached(frontier))
        if step.isEmpty():
            break
        lead = F.min("entity") if route == "frontier" else F.min("subject_id")
        hits = step.groupBy("query_id", "claim_id").agg(lead.alias("route")).withColumn("hop", F.lit(hop))
        if found is not None:
            hits = hits.join(found.select("query_id", "claim_id"), ["query_id", "claim_id"], "left_anti")
        hits = settle(hits)
        found = hits if found is None else found.unionByName(hits)
        frontier = step.select("query_id", F.col("other").alias("entity")).where("entity IS NOT NULL").distinct().join(seen, ["query_id", "entity"], "left_anti")
        if limit is not None:
            frontier = frontier.join(found.groupBy("query_id").count().where(F.col("count") >= limit), "query_id", "left_anti")
        frontier = settle(frontier)
        seen = seen.unionByName(frontier)
    if found is None:
        found = seen.select("query_id", F.lit(None).cast("string").alias("claim_id"), F.lit(None).cast("string").alias("route"), F.lit(0).alias("hop")).where("false")
    score = 1.0 / F.col("hop") if scoring == "inverse" else 0.3 / F.col("hop")
    return found.select("query_id", "claim_id", "hop", score.alias("score"), "route")


def type_closure(parents: DataFrame) -> DataFrame:
    """type_id, ancestor: each type with itself and all it extends, paths doubling each round until none is new."""
    own = parents.select("type_id").union(parents.select("parent_id")).distinct().select("type_id", F.col("type_id").alias("ancestor"))
    paths = settle(own.union(parents.select("type_id", "parent_id")).distinct())
    n = paths.count()
    while True:
        far = paths.select(F.col("type_id").alias("ancestor"), F.col("ancestor").alias("further"))
        paths = settle(paths.join(far, "ancestor").select("type_id", F.col("further").alias("ancestor")).distinct())
        if (m := paths.count()) == n:
            break
        n = m
    return paths


def cyclic_types(parents: DataFrame) -> DataFrame:
    """type_id of types from which some walk reaches a cycle: those on a cycle, which reach themselves, and all that reach one of them. Paths double each round, until none is new."""
    paths = settle(parents.select("type_id", F.col("parent_id").alias("ancestor")).distinct())
    n = 0
    while (m := paths.count()) != n:
        n = m
        far = paths.select(F.col("type_id").alias("ancestor"), F.col("ancestor").alias("further"))
        paths = settle(paths.union(paths.join(far, "ancestor").select("type_id", F.col("further").alias("ancestor"))).distinct())
    on_cycle = paths.where("type_id = ancestor").select(F.col("type_id").alias("ancestor"))
    return paths.join(on_cycle, "ancestor", "left_semi").select("type_id").distinct()
