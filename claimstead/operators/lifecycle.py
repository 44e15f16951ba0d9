"""Facts recorded about decisions after they were taken, read from the event log, and the guards of review workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimstead.operators.records import events, make_id

# Event kinds of the facts.
KINDS = {"relation": "decision.related", "outcome": "decision.outcome_observed", "exception": "policy.exception_recorded", "approval": "decision.approved"}


#: Rows of a task where rows are dealt by their number, in expectation.
ROWS = 1_000_000


def facts(log: DataFrame, fact: str, schema: str) -> DataFrame:
    """Payload columns of one kind of fact, with its event id and instant."""
    own = log.where(F.col("kind") == KINDS[fact])
    return own.select("event_id", "occurred_at", F.from_json("payload", schema).alias("p")).select("event_id", "occurred_at", "p.*")


def recorded_facts(rows: DataFrame, fact: str, at: Column) -> DataFrame:
    """The events that record facts about decisions (relations, outcomes, exceptions, approvals), each with an id of all its columns."""
    id_ = f"{fact}_id"
    return events(rows.withColumn(id_, make_id(fact, *[F.col(c) for c in rows.columns], at)), KINDS[fact], id_, at)


def applied(requests: DataFrame, guard: DataFrame, on: list[str], kind: str, at: Column, allowed: DataFrame | None = None) -> dict[str, DataFrame]:
    """allowed: the guard of a write check (write_access.entity_write) by request_id, whose errors count too. accepted, events, outbox and rejected of requests to change a state (reviews, merges, reverts, resolutions), by their guard's errors.

    An accepted request has one event of the kind, which is put in the outbox too; the state is read from those events, nothing is updated in place.
    """
    judged = requests.join(guard.select(*on, "errors"), on)
    if allowed is not None:
        judged = judged.join(allowed.select("request_id", F.col("errors").alias("_denied")), "request_id").withColumn("errors", F.concat("_denied", "errors")).drop("_denied")
    good = judged.where(F.size("errors") == 0).drop("errors")
    keyed = good.withColumn("request_key", make_id(kind, *[F.col(c) for c in on]))
    log = events(keyed, kind, "request_key", at)
    return {"accepted": good, "events": log, "outbox": log.select("event_id"), "rejected": judged.where(F.size("errors") > 0).select(*on, "errors")}


def in_scope(rows: DataFrame, tenant: str, namespace: str | None = None, decision: str | None = None) -> DataFrame:
    out = rows.where(F.col("tenant_id") == tenant)
    out = out if namespace is None else out.where(F.col("namespace_id") == namespace)
    return out if decision is None else out.where(F.col("decision_id") == decision)


def proposals_of(rows: DataFrame, tenant: str, namespace: str | None = None, entity: str | None = None) -> DataFrame:
    """Proposals of a tenant, perhaps of a namespace, and perhaps with an entity at either end."""
    own = in_scope(rows, tenant, namespace)
    return own if entity is None else own.where((F.col("source_id") == entity) | (F.col("candidate_id") == entity))


def relations_of(decisions: DataFrame, relations: DataFrame, tasks: int | None = None) -> DataFrame:
    """decision_id, relation_id, role: a relation is seen from both ends, by one equi-join over its exploded ends, which are dealt over `tasks` by their decisions if that is given."""
    ends = relations.select("relation_id", F.explode(F.array(F.struct(F.col("from_id").alias("decision_id"), F.lit("from").alias("role")), F.struct(F.col("to_id").alias("decision_id"), F.lit("to").alias("role")))).alias("e")).select("relation_id", "e.*")
    return decisions.select("decision_id").join(ends if tasks is None else ends.repartition(tasks, "decision_id"), "decision_id")


def touching(decisions: DataFrame, log: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """decision_id, event_id of events about a decision, its claims or its evidence: three equi-joins and a union."""
    about = log.select("event_id", "subject_id")
    parts = [decisions.select("decision_id", F.col("decision_id").cast("string").alias("subject_id")), claims.select("decision_id", F.col("claim_id").alias("subject_id")), evidence.select("decision_id", F.col("evidence_id").alias("subject_id"))]
    found = [p.join(about, "subject_id").select("decision_id", "event_id") for p in parts]
    return found[0].union(found[1]).union(found[2]).distinct()


def proposal_errors(proposals: DataFrame, state: DataFrame, roots: DataFrame) -> DataFrame:
    """proposal_id, errors for new proposals (source_id, candidate_id, n_signals) against the state of earlier ones (source_id, candidate_id, state)."""
    moved = roots.select(F.col("entity_id").alias("_e"), F.lit(True).alias("_gone")).where("_e IS NOT NULL")
    pair = lambda df: F.concat_ws("\u0001", F.least(df["source_id"], df["candidate_id"]), F.greatest(df["source_id"], df["candidate_id"]))
    busy = state.where("state IN ('open', 'approved', 'merged')").select(pair(state).alias("_pair"), F.lit(True).alias("_busy")).distinct()
    p = proposals.withColumn("_pair", pair(proposals)).join(busy, "_pair", "left")
    p = p.join(moved, p["source_id"] == moved["_e"], "left").withColumnRenamed("_gone", "_s").drop("_e").join(moved, F.col("candidate_id") == F.col("_e"), "left")
    errors = F.array_compact(F.array(
        F.when(F.col("source_id") == F.col("candidate_id"), "SAME_ENTITY"), F.when(F.col("_s").isNotNull() | F.col("_gone").isNotNull(), "NOT_CANONICAL"),
        F.when(F.col("_busy").isNotNull(), "EQUIVALENT_PROPOSAL"), F.when(F.coalesce("n_signals", F.lit(0)) < 1, "SIGNAL_REQUIRED"),
    ))
    return p.select("proposal_id", errors.alias("errors"))


def review_errors(reviews: DataFrame) -> DataFrame:
    """proposal_id, decided_seq, errors: a proposal is decided once and for a reason; later reviews of it are in error."""
    order = Window.partitionBy("proposal_id").orderBy("decided_seq")
    errors = F.array_compact(F.array(F.when(F.row_number().over(order) > 1, "ALREADY_DECIDED"), F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "REASON_REQUIRED")))
    return reviews.select("proposal_id", "decided_seq", errors.alias("errors"))


def merge_guard(requests: DataFrame, proposals: DataFrame, reviews: DataFrame, merges: DataFrame) -> DataFrame:
    """request_id, errors of requests (request_id, proposal_id, surviving_id) to merge: the proposal exists, its last review approves it, the survivor is one of its two entities, and it wasn't merged before, nor by an earlier request."""
    p = proposals.select(F.col("proposal_id").alias("_p"), "source_id", "candidate_id")
    last = reviews.groupBy(F.col("proposal_id").alias("_r")).agg(F.max(F.struct("decided_seq", "outcome")).alias("last"))
    done = merges.select(F.col("proposal_id").alias("_m")).distinct()
    r = requests.join(p, F.col("proposal_id") == F.col("_p"), "left").join(last, F.col("proposal_id") == F.col("_r"), "left").join(done, F.col("proposal_id") == F.col("_m"), "left")
    again = F.row_number().over(Window.partitionBy("proposal_id").orderBy("request_id")) > 1
    errors = F.array_compact(F.array(
        F.when(F.col("_p").isNull(), "UNKNOWN_PROPOSAL"), F.when(F.col("_p").isNotNull() & ~F.coalesce(F.col("last.outcome") == "approve", F.lit(False)), "NOT_APPROVED"),
        F.when(F.col("_p").isNotNull() & ~((F.col("surviving_id") == F.col("source_id")) | (F.col("surviving_id") == F.col("candidate_id"))), "SURVIVOR_OUTSIDE_PAIR"), F.when(F.col("_m").isNotNull() | again, "ALREADY_MERGED"),
    ))
    return r.select("request_id", "proposal_id", errors.alias("errors"))


def revert_guard(requests: DataFrame, merges: DataFrame) -> DataFrame:
    """request_id, errors of requests (request_id, merge_id, reason) to revert: the merge exists, isn't reverted, nor by an earlier request, and a reason is given."""
    m = merges.select(F.col("merge_id").alias("_m"), "reverted")
    again = F.row_number().over(Window.partitionBy("merge_id").orderBy("request_id")) > 1
    errors = F.array_compact(F.array(
        F.when(F.col("_m").isNull(), "UNKNOWN_MERGE"), F.when(F.coalesce("reverted", F.lit(False)) | again, "ALREADY_REVERTED"), F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "REASON_REQUIRED"),
    ))
    return requests.join(m, F.col("merge_id") == F.col("_m"), "left").select("request_id", "merge_id", errors.alias("errors"))


def resolution_guard(resolutions: DataFrame, conflicts: DataFrame, resolved: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """resolution_id, errors: the conflict exists with the same claims, has no resolution yet, the preferred claim is among its claims, and all of them exist where claims are given."""
    known = conflicts.select(F.col("conflict_id").alias("_c"), F.sort_array("claim_ids").alias("_ids"))
    done = resolved.select(F.col("conflict_id").alias("_d")).distinct()
    r = resolutions.join(known, resolutions["conflict_id"] == F.col("_c"), "left").join(done, F.col("conflict_id") == F.col("_d"), "left")
    errors = F.array_compact(F.array(
        F.when(F.col("_c").isNull(), "UNKNOWN_CONFLICT"), F.when(~F.col("_ids").eqNullSafe(F.sort_array("claim_ids")) & F.col("_c").isNotNull(), "CLAIM_SET_DIFFERS"),
        F.when(F.col("_d").isNotNull(), "ALREADY_RESOLVED"), F.when(~F.array_contains("claim_ids", F.col("preferred_claim_id")), "PREFERRED_OUTSIDE"),
    ))
    if claims is None:
        return r.select("resolution_id", errors.alias("errors"))
    named = resolutions.select("resolution_id", F.explode("claim_ids").alias("claim_id"))
    lost = named.join(claims.select("claim_id"), "claim_id", "left_anti").select(F.col("resolution_id").alias("_lost")).distinct()
    missing = F.when(F.col("_lost").isNotNull(), F.array(F.lit("UNKNOWN_CLAIM"))).otherwise(F.array().cast("array<string>"))
    return r.withColumn("errors", errors).join(lost, F.col("resolution_id") == F.col("_lost"), "left").select("resolution_id", F.concat("errors", missing).alias("errors"))
