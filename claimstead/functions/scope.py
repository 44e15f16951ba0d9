"""Classification, visibility and the access decision, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orders of classification and visibility, and the actions that write.
CLASSIFICATIONS = ["public", "internal", "confidential", "tlp:amber", "tlp:red"]
VISIBILITIES = ["public", "workspace", "private"]
WRITE_ACTIONS = [
    "knowledge.write", "entity.resolve", "entity.merge", "memory.write", "decision.record", "decision.relate", "decision.observe", "decision.approve", "ingestion.write",
    "policy.evaluate", "policy.manage", "policy.exception", "conflict.detect", "conflict.resolve", "admin",
]


def rank(value: Column, order: list[str]) -> Column:
    """Place in an order, from 0; null for other values."""
    at = F.array_position(F.lit(order), value)
    return F.when(at > 0, at - 1)


def classification_rank(value: Column) -> Column:
    return rank(value, CLASSIFICATIONS)


def of_rank(place: Column, order: list[str]) -> Column:
    return F.get(F.lit(order), place.cast("int"))


def access_reason(principal: Column, action: Column, resource: Column, context: Column) -> Column:
    """ALLOW or the first rule that denies.

    principal: tenant_id, principal_id, kind, acting_for, clearance, roles, namespace_ids; resource: tenant_id, namespace_id,
    classification, visibility, owner_id; context: tenant_id, now, purpose, delegation (delegator_id, scope, expires_at, purpose). An unknown
    classification is denied.
    """
    p, r, c = principal, resource, context
    d = c["delegation"]
    has = lambda role: F.array_contains(p["roles"], role)
    delegated = (p["kind"] == "agent") & p["acting_for"].isNotNull()
    valid = (
        d.isNotNull()
        & d["delegator_id"].eqNullSafe(p["acting_for"])
        & F.coalesce(F.array_contains(d["scope"], action), F.lit(False))
        & ~F.coalesce(c["now"] > d["expires_at"], F.lit(False))
        & ~F.coalesce(c["purpose"] != d["purpose"], F.lit(False))
    )
    acting_as = F.when(delegated, p["acting_for"]).otherwise(p["principal_id"])
    return (
        F.when(~(p["tenant_id"].eqNullSafe(c["tenant_id"]) & r["tenant_id"].eqNullSafe(c["tenant_id"])), "CROSS_TENANT_DENIED")
        .when(~F.coalesce(classification_rank(p["clearance"]) >= classification_rank(r["classification"]), F.lit(False)), "CLASSIFICATION_DENIED")
        .when((action == "admin") & ~has("admin"), "ACTION_DENIED")
        .when(delegated & ~valid, "DELEGATION_DENIED")
        .when((r["visibility"] == "private") & r["owner_id"].isNotNull() & (r["owner_id"] != acting_as), "VISIBILITY_DENIED")
        .when(~F.coalesce(F.array_contains(p["namespace_ids"], r["namespace_id"]), F.lit(False)), "NAMESPACE_DENIED")
        .when(action.isin(WRITE_ACTIONS) & has("viewer") & ~has("admin"), "ACTION_DENIED")
        .otherwise("ALLOW")
    )


def default_scope(tenant: Column, namespace: Column, classification: Column, visibility: Column) -> Column:
    return F.struct(
        F.coalesce(tenant, F.lit("local")).alias("tenant_id"), F.coalesce(namespace, F.lit("default")).alias("namespace_id"),
        F.coalesce(classification, F.lit("internal")).alias("classification"), F.coalesce(visibility, F.lit("workspace")).alias("visibility"),
    )
