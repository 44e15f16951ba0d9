"""Row-level access: reasons, filters, receipts and omissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.scope import CLASSIFICATIONS, VISIBILITIES, access_reason, of_rank, rank

DELEGATION = "struct<delegator_id: string, scope: array<string>, expires_at: timestamp_ntz, purpose: string>"


def reader(principal_id: str, tenant: str, namespaces: list[str], clearance: str, roles: list[str], kind: str = "human", acting_for: str | None = None) -> Column:
    strings = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    return F.struct(
        F.lit(principal_id).alias("principal_id"), F.lit(tenant).alias("tenant_id"), strings(namespaces).alias("namespace_ids"), F.lit(clearance).alias("clearance"),
        strings(roles).alias("roles"), F.lit(kind).alias("kind"), F.lit(acting_for).cast("string").alias("acting_for"),
    )


def delegation(delegator: str, scope: list[str], expires_at: str, purpose: str | None) -> Column:
    return F.struct(F.lit(delegator).alias("delegator_id"), F.array(*map(F.lit, scope)).alias("scope"), F.lit(expires_at).cast("timestamp_ntz").alias("expires_at"), F.lit(purpose).cast("string").alias("purpose"))


def context(tenant: Column, now: Column, purpose: str | None = None, given: Column | None = None) -> Column:
    return F.struct(tenant.alias("tenant_id"), now.alias("now"), F.lit(purpose).cast("string").alias("purpose"), (F.lit(None) if given is None else given).cast(DELEGATION).alias("delegation"))


def reasons(rows: DataFrame, readers: list[Column], action: str, now: Column, purpose: str | None = None, given: Column | None = None) -> DataFrame:
    """A row for each row and reader with the reason. Readers are literals laid beside each row, so nothing is joined."""
    dealt = rows.withColumn("_p", F.explode(F.array(*readers)))
    resource = F.struct("tenant_id", "namespace_id", "classification", "visibility", "owner_id")
    reason = access_reason(F.col("_p"), F.lit(action), resource, context(F.col("_p.tenant_id"), now, purpose, given))
    return dealt.withColumns({"principal_id": F.col("_p.principal_id"), "reason": reason}).drop("_p")


def allowed(rows: DataFrame, readers: list[Column], action: str, now: Column) -> DataFrame:
    return reasons(rows, readers, action, now).where("reason = 'ALLOW'")


def read_or_reject(rows: DataFrame, reader_: Column, action: str, now: Column, purpose: str | None = None, given: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that a reader may read, and those that are refused with their reason: a read by id is answered or refused, never silently left out."""
    decided = reasons(rows, [reader_], action, now, purpose, given)
    return decided.where("reason = 'ALLOW'").drop("principal_id", "reason"), decided.where("reason <> 'ALLOW'").drop("principal_id")


def in_namespaces(rows: DataFrame, reader_: Column, id_: str) -> DataFrame:
    """Rows of the reader's tenant over all their namespaces, in the order of the id."""
    held = rows.withColumn("_p", reader_)
    return held.where((F.col("tenant_id") == F.col("_p.tenant_id")) & F.array_contains("_p.namespace_ids", F.col("namespace_id"))).drop("_p").orderBy(id_)


def receipts(decided: DataFrame, action: str, kind: str, id_: str, at: Column, also: list[str] | None = None) -> DataFrame:
    """One receipt per decision, denied ones too; also: further columns to keep."""
    effect = F.when(F.col("reason") == "ALLOW", "allow").otherwise("deny")
    return decided.select(*(also or []), F.col("principal_id"), F.lit(action).alias("action"), F.lit(kind).alias("resource_kind"), F.col(id_).alias("resource_id"), effect.alias("effect"), "reason", at.alias("evaluated_at"))


def unique_receipts(rows: DataFrame) -> DataFrame:
    """The last receipt of each (action, kind, id)."""
    rest = [c for c in rows.columns if c not in ("action", "resource_kind", "resource_id", "evaluated_at")]
    top = rows.groupBy("action", "resource_kind", "resource_id").agg(F.max(F.struct("evaluated_at", *rest)).alias("t"))
    return top.select("action", "resource_kind", "resource_id", "t.*")


def omissions(decided: DataFrame, by: str = "principal_id") -> DataFrame:
    """Denied rows by classification."""
    return decided.where("reason <> 'ALLOW'").groupBy(by, "classification").agg(F.count(F.lit(1)).alias("omitted"))


def assert_allowed(decided: DataFrame) -> DataFrame:
    """The rows, failing the job at the first denied one."""
    return decided.withColumn("reason", F.when(F.col("reason") == "ALLOW", F.col("reason")).otherwise(F.raise_error(F.concat(F.lit("access denied: "), F.col("reason")))))


def all_members_allowed(decided: DataFrame, group: str) -> DataFrame:
    return decided.groupBy(group).agg(F.every(F.col("reason") == "ALLOW").alias("allowed"))


def strictest_scope(rows: DataFrame, group: list[str]) -> DataFrame:
    """Strictest classification and visibility of a group, and the sorted union of its policy tags if it has any."""
    tags = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("policy_tags")))).alias("policy_tags")] if "policy_tags" in rows.columns else []
    strict = rows.groupBy(*group).agg(
        of_rank(F.max(rank(F.col("classification"), CLASSIFICATIONS)), CLASSIFICATIONS).alias("classification"), of_rank(F.max(rank(F.col("visibility"), VISIBILITIES)), VISIBILITIES).alias("visibility"), *tags
    )
    return strict
