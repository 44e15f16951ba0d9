"""Write rules as error codes per row, and the split into good and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload keys that are refused.
HIDDEN_REASONING = ["chainOfThought", "hiddenCoT", "privateReasoning", "hiddenChainOfThought"]


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def bad_instant(value: Column) -> Column:
    """Whether an instant is missing or, as text, doesn't parse."""
    return value.isNull() | F.try_to_timestamp(value.cast("string")).isNull()


def snapshot_errors(snapshot_id: Column, payload: Column) -> Column:
    """A decision needs a context snapshot and no hidden reasoning in its payload."""
    return F.array_compact(F.array(F.when(blank(snapshot_id), "CONTEXT_SNAPSHOT_REQUIRED"), F.when(hidden_reasoning(payload), "HIDDEN_REASONING")))


def claim_errors(claim_id: Column, confidence: Column, valid_from: Column, valid_to: Column, evidence_ids: Column, provenance: Column) -> Column:
    """Codes of the violated rules, in a fixed order; empty for a good claim. provenance: source, actor, process and timestamp, as text or as an instant."""
    missing = bad_instant(provenance["timestamp"])
    for field in ("source", "actor", "process"):
        missing = missing | blank(provenance[field])
    return F.array_compact(F.array(
        F.when(blank(claim_id), "BLANK_ID"),
        F.when(~F.coalesce(confidence.between(0, 1) & ~F.isnan(confidence), F.lit(False)), "CONFIDENCE_RANGE"),
        F.when(valid_to <= valid_from, "INVALID_INTERVAL"),
        F.when(F.coalesce(F.size(evidence_ids), F.lit(0)) < 1, "EVIDENCE_REQUIRED"),
        F.when(provenance.isNull() | missing, "PROVENANCE_REQUIRED"),
    ))


def hidden_reasoning(payload: Column) -> Column:
    """Whether a JSON payload carries a refused key."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(payload), F.array(*map(F.lit, HIDDEN_REASONING))), F.lit(False))


def merge_errors(surviving: Column, absorbed: Column) -> Column:
    return F.array_compact(F.array(F.when(F.size(absorbed) < 1, "ABSORBED_REQUIRED"), F.when(F.array_contains(absorbed, surviving), "SURVIVOR_ABSORBED")))


def resolution_errors(claim_ids: Column, preferred: Column) -> Column:
    return F.array_compact(F.array(F.when(F.size(claim_ids) < 2, "TWO_CLAIMS_REQUIRED"), F.when(~F.array_contains(claim_ids, preferred), "PREFERRED_OUTSIDE")))


def policy_errors(effective_from: Column, effective_to: Column) -> Column:
    return F.array_compact(F.array(F.when(effective_to <= effective_from, "INVALID_EFFECTIVE_WINDOW")))


def rule_errors(rules: DataFrame) -> DataFrame:
    """Terms of more than one rule, and rules without a positive maximum: (term, code)."""
    terms = rules.select("rule_id", "max", F.explode("terms").alias("term"))
    clashing = terms.groupBy("term").agg(F.count_distinct("rule_id").alias("n")).where("n > 1").select("term", F.lit("TERM_IN_TWO_RULES").alias("code"))
    return clashing.unionByName(terms.where("max IS NULL OR max < 1").select("term", F.lit("MAX_NOT_POSITIVE").alias("code")))


def one_scope(rows: DataFrame, group: str) -> DataFrame:
    """Groups whose rows share tenant and namespace."""
    return rows.groupBy(group).agg((F.count_distinct("tenant_id", "namespace_id") == 1).alias("one_scope"))


def missing_references(rows: DataFrame, ids: str, known: DataFrame, id_: str) -> DataFrame:
    """Exploded references of rows without a match."""
    return rows.withColumn("reference", F.explode(ids)).join(known.select(F.col(id_).alias("reference")), "reference", "left_anti")


def split(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their errors."""
    marked = rows.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)
