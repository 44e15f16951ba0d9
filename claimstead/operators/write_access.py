"""Write checks: every record that a request touches is judged for its own writer before anything is written; receipts tell every judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.scope import access_reason
from claimstead.operators import access
from claimstead.operators.identity import settle
from claimstead.operators.lifecycle import KINDS
from claimstead.operators.records import events, make_id

SCOPE = ["tenant_id", "namespace_id", "classification", "visibility", "owner_id"]

# What a writer must be allowed to do to record a fact about a decision, and the purpose that it is done for.
ACTIONS = {"relation": ("decision.relate", "decision-relate"), "outcome": ("decision.observe", "decision-observe"), "exception": ("policy.exception", "policy-exception"), "approval": ("decision.approve", "decision-approve")}


def judged(requests: DataFrame, members: DataFrame, resources: DataFrame, action: str, now: Column, purpose: str | None = None) -> DataFrame:
    """request_id, principal_id, resource_id, reason for every member of a request: ALLOW, what denies it, or NOT_FOUND.

    requests: request_id, writer, and delegation where they have it; members: request_id, resource_id; resources: resource_id, SCOPE, a row each. A resource that very many requests
    name is a skewed key of an equi-join, which Spark splits.
    """
    asking = requests.select("request_id", F.col("writer").alias("_w"), (F.col("delegation") if "delegation" in requests.columns else F.lit(None)).cast(access.DELEGATION).alias("_given"))
    held = resources.select("resource_id", F.struct(*[F.col(c) if c in resources.columns else F.lit(None).cast("string").alias(c) for c in SCOPE]).alias("_r"))
    beside = members.select("request_id", "resource_id").distinct().join(held, "resource_id", "left").join(asking, "request_id")
    given = F.struct(F.col("_w.tenant_id").alias("tenant_id"), now.alias("now"), F.lit(purpose).cast("string").alias("purpose"), F.col("_given").alias("delegation"))
    reason = F.when(F.col("_r").isNull(), "NOT_FOUND").otherwise(access_reason(F.col("_w"), F.lit(action), F.col("_r"), given))
    return beside.select("request_id", F.col("_w.principal_id").alias("principal_id"), "resource_id", reason.alias("reason"))


def guard(requests: DataFrame, decided: DataFrame) -> DataFrame:
    """request_id, errors: the distinct reasons, in order, for which members of a request are refused; empty where every one is allowed."""
    bad = decided.where("reason <> 'ALLOW'").groupBy("request_id").agg(F.sort_array(F.collect_set("reason")).alias("errors"))
    return requests.select("request_id").join(bad, "request_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def both(first: DataFrame, second: DataFrame) -> DataFrame:
    """The errors of two guards of the same requests, those of the first before those of the second."""
    return first.join(second.select("request_id", F.col("errors").alias("_more")), "request_id").withColumn("errors", F.concat("errors", "_more")).drop("_more")


def entity_write(requests: DataFrame, members: DataFrame, entities: DataFrame, action: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The guard and the receipts of requests to propose, decide or merge entities: each of a request's entities must be writable for its writer. action: entity.resolve or entity.merge."""
    decided = settle(judged(requests, members, entities, action, now, "entity-resolution"))
    return guard(requests, decided), access.receipts(decided, action, "entity", "resource_id", now, also=["request_id"])


def record_facts(rows: DataFrame, fact: str, decisions: DataFrame, at: Column, evidence: DataFrame | None = None) -> dict[str, DataFrame]:
    """records, events, outbox, rejected and receipts of facts about decisions (relation, outcome, exception, approval).

    rows: request_id, writer, decision_id and the fact's own columns, evidence_ids among them where it has evidence; decisions and evidence: decision_id or evidence_id, SCOPE. The writer must be
    allowed the fact's action on the decision, and to read every evidence it names; evidence that doesn't exist is EVIDENCE_NOT_FOUND. A record has an id of all
    its columns, an event, and a place in the outbox.
    """
    action, purpose = ACTIONS[fact]
    told = settle(judged(rows, rows.select("request_id", F.col("decision_id").alias("resource_id")), decisions.withColumnRenamed("decision_id", "resource_id"), action, at, purpose))
    checks, receipts = guard(rows, told), access.receipts(told, action, "decision", "resource_id", at, also=["request_id"])
    if evidence is not None:
        named = rows.select("request_id", F.explode("evidence_ids").alias("resource_id"))
        read = settle(judged(rows, named, evidence.withColumnRenamed("evidence_id", "resource_id"), "knowledge.read", at, purpose).withColumn("reason", F.when(F.col("reason") == "NOT_FOUND", "EVIDENCE_NOT_FOUND").otherwise(F.col("reason"))))
        checks = both(checks, guard(rows, read))
        proof = access.receipts(read, "knowledge.read", "evidence", "resource_id", at, also=["request_id"])
        receipts = receipts.withColumn("resource_id", F.col("resource_id").cast("string")).unionByName(proof.withColumn("resource_id", F.col("resource_id").cast("string")))
    marked = settle(rows.join(checks, "request_id"))
    own = [c for c in rows.columns if c not in ("writer", "delegation")]
    good = marked.where(F.size("errors") == 0).select(*own, F.col("writer.principal_id").alias("recorded_by"))
    key = f"{fact}_id"
    whole = good.withColumn(key, make_id(fact, *[F.to_json(F.struct(F.col(c))) for c in good.columns], at)).withColumn("recorded_at", at)
    log = events(whole, KINDS[fact], key, at)
    return {"records": whole, "events": log, "outbox": log.select("event_id"), "rejected": marked.where(F.size("errors") > 0).select("request_id", "errors"), "receipts": receipts}
