"""Constructors of records and their events, as selects over tables of requests. Ids are hashes of natural keys, so runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make_id(kind: str, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(kind), *[k.cast("string") for k in keys]), 256)


def provenance(source: Column, actor: Column, process: Column, at: Column, parents: Column | None = None) -> Column:
    return F.struct(source.alias("source"), actor.alias("actor"), process.alias("process"), at.alias("timestamp"), (F.array().cast("array<string>") if parents is None else parents).alias("parent_ids"))


def claims(rows: DataFrame, at: Column) -> DataFrame:
    """Asserted claims: given status or asserted, recorded at the run's instant, asserted then too unless told otherwise."""
    status = F.coalesce("status", F.lit("asserted")) if "status" in rows.columns else F.lit("asserted")
    asserted = F.coalesce("asserted_at", at) if "asserted_at" in rows.columns else at
    return rows.withColumns({"status": status, "recorded_at": at, "asserted_at": asserted, "claim_id": make_id("claim", F.col("subject_id"), F.col("predicate"), F.col("object_value"), F.col("valid_from"))})


def entity_key() -> Column:
    return make_id("entity", F.col("tenant_id"), F.col("namespace_id"), F.lower(F.trim("label")))


def entities(rows: DataFrame) -> DataFrame:
    """Entities of (tenant_id, namespace_id, label, aliases), one per lower-cased label, with the least of its spellings. Names are rows of their own (entity_names), as an entity may have any number of them."""
    return rows.groupBy(entity_key().alias("entity_id"), "tenant_id", "namespace_id").agg(F.min("label").alias("label"))


def entity_names(rows: DataFrame) -> DataFrame:
    """entity_id, name, source of all labels and aliases, each once."""
    keyed = rows.withColumn("entity_id", entity_key())
    labels = keyed.select("entity_id", F.col("label").alias("name"), F.lit("label").alias("source"))
    return labels.unionByName(keyed.select("entity_id", F.explode("aliases").alias("name"), F.lit("alias").alias("source"))).distinct()


def merge_events(rows: DataFrame, at: Column) -> DataFrame:
    """Merge events of (surviving_id, absorbed_ids)."""
    return rows.select(make_id("merge", F.col("surviving_id"), F.array_join(F.sort_array("absorbed_ids"), ",")).alias("event_id"), F.lit("entity.merged").alias("kind"), "surviving_id", "absorbed_ids", at.alias("occurred_at"))


def memories(rows: DataFrame, at: Column) -> DataFrame:
    """Memory rows with ids by owner, kind, body and instant."""
    return rows.withColumns({"memory_id": make_id("memory", F.col("owner_id"), F.col("kind"), F.col("body"), at), "recorded_at": at})


def decisions(rows: DataFrame, at: Column) -> DataFrame:
    """Decision rows with ids by actor, purpose and instant; confidence stays null where it isn't given."""
    return rows.withColumns({"decision_id": make_id("decision", F.col("actor"), F.col("purpose"), at), "recorded_at": at})


def events(rows: DataFrame, kind: str, id_: str, at: Column) -> DataFrame:
    """The event of each record, with the record as JSON payload."""
    return rows.select(make_id(kind, F.col(id_)).alias("event_id"), F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("subject_id"), F.to_json(F.struct(*rows.columns)).alias("payload"), at.alias("occurred_at"))


def policy_versions(rows: DataFrame) -> DataFrame:
    """Policy rows with a version id of their logical id and version."""
    return rows.withColumn("version_id", make_id("policy", F.col("policy_id"), F.col("version")))
