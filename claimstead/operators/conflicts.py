"""Cardinality conflicts among claims, their resolutions, and what those suppress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.functions.temporal import open_end
from claimstead.functions.text import claim_object, conflict_identity
from claimstead.operators import sweep
from claimstead.operators.access import strictest_scope
from claimstead.operators.identity import canonical_claims, small


def rule_terms(rules: DataFrame) -> DataFrame:
    """term, rule_id, max: a row per synonym."""
    return rules.select(F.explode("terms").alias("term"), "rule_id", F.col("max").alias("rule_max"))


def detect(claims: DataFrame, rules: DataFrame, roots: DataFrame | None = None, per_range: int = sweep.RANGE) -> DataFrame:
    """group columns, claim_ids, rule_id: maximal sets of claims that hold at once and have more objects than their rule allows.

    Objects are entities or literals; with roots (entity_id, canonical_id), subjects and entity objects count by their roots.

    At each start of validity in a group (tenant, namespace, canonical subject, rule), the claims that hold are reduced to the least id
    per object; sets over the maximum are kept once, and sets inside a larger one are dropped. A plane sweep (sweep.held_sets): starts are joined with no claims, and sets only with those that
    share their rarest member.
    """
    group = ["tenant_id", "namespace_id", "subject_id", "rule_id"]
    claims = claims if roots is None else canonical_claims(claims, roots)
    live = claims.withColumn("object", claim_object(claims)).where("status <> 'retracted'").join(small(rule_terms(rules)), F.col("predicate") == F.col("term"))
    live = live.select(*group, "rule_max", "claim_id", "object", "valid_from", open_end(F.col("valid_to")).alias("valid_end"))
    return sweep.widest(sweep.held_sets(live, group, "rule_max", per_range), group)


def records(found: DataFrame, claims: DataFrame, cause: str) -> DataFrame:
    """Conflict rows: identity, claim ids, and the strictest scope of their claims."""
    named = found.withColumn("conflict_id", F.sha2(conflict_identity(F.lit(cause), F.col("claim_ids")), 256))
    members = named.select("conflict_id", F.explode("claim_ids").alias("claim_id")).join(claims.select("claim_id", "classification", "visibility"), "claim_id")
    return named.join(strictest_scope(members, ["conflict_id"]), "conflict_id").withColumn("cause", F.lit(cause))


def not_recorded(found: DataFrame, recorded: DataFrame) -> DataFrame:
    return found.join(recorded.select("conflict_id"), "conflict_id", "left_anti")


def suppressed(resolutions: DataFrame) -> DataFrame:
    """claim_id, and tenant_id where resolutions have it, of all claims of a resolved conflict but the preferred one."""
    return resolutions.select(*[c for c in ("tenant_id",) if c in resolutions.columns], F.explode(F.array_remove(F.col("claim_ids"), F.col("preferred_claim_id"))).alias("claim_id")).distinct()
