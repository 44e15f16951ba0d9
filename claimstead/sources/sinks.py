"""Append-only tables: versions, events, outbox, blobs and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.operators.temporal import latest


def put_versions(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The version table with changes appended; nothing is overwritten."""
    return current.unionByName(changes, allowMissingColumns=True)


def retract(versions: DataFrame, ids: DataFrame, at: Column, key: str = "claim_id") -> DataFrame:
    """New retracted versions of current claims named by ids; claims that are retracted already are left out."""
    now = latest(versions, key, ["recorded_at", "version_seq"]).join(ids.select(key).distinct(), key, "left_semi").where("status <> 'retracted'")
    return now.withColumns({"status": F.lit("retracted"), "recorded_at": at, "version_seq": F.col("version_seq") + 1})


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose id isn't stored yet, each once."""
    return events.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti")


def outbox(events: DataFrame, acknowledged: DataFrame) -> DataFrame:
    return events.join(acknowledged.select("event_id"), "event_id", "left_anti")


def put_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs (blob_key, content, content_type) with new keys."""
    return blobs.dropDuplicates(["blob_key"]).join(stored.select("blob_key"), "blob_key", "left_anti")


def put_embeddings(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The last vector of each claim."""
    return latest(stored.unionByName(changes), "claim_id", ["written_at"])


def clear_embeddings(stored: DataFrame) -> DataFrame:
    """The table without a vector, to be written over it."""
    return stored.limit(0)


def append(rows: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """Appends records (receipts, snapshots, decisions, memories, policies, conflicts, resolutions) to their table, laid out by the columns `by`."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(folder)


def write_requests(requests: DataFrame, folder: str) -> None:
    requests.write.mode("append").json(folder)


def projection(claims: DataFrame, events: DataFrame, roots: DataFrame, embed) -> DataFrame:
    """The retrieval projection rebuilt: claims that some claim event names and that aren't retracted, with canonical ends, text and vector (embed makes it from the text's column)."""
    named = events.where(F.col("kind").isin(CLAIM_EVENTS)).select("claim_id").distinct()
    live = claims.join(named, "claim_id", "left_semi").where("status <> 'retracted'")
    subject = roots.select(F.col("entity_id").alias("_s"), F.col("canonical_id").alias("_sc"))
    object_ = roots.select(F.col("entity_id").alias("_o"), F.col("canonical_id").alias("_oc"))
    joined = live.join(subject, live["subject_id"] == F.col("_s"), "left").join(object_, live["object_entity_id"] == F.col("_o"), "left")
    text = F.concat_ws(" ", "predicate", F.coalesce("object_value", "object_entity_id"))
    return joined.withColumns({"canonical_subject": F.coalesce("_sc", "subject_id"), "canonical_object": F.coalesce("_oc", "object_entity_id"), "text": text}).withColumn("vector", embed(F.col("text"))).drop("_s", "_sc", "_o", "_oc")


def upsert(projected: DataFrame, touched: DataFrame, rows: DataFrame) -> DataFrame:
    """A projection with the rows of touched claim_ids replaced: those without a new row are deleted."""
    return projected.join(touched.select("claim_id").distinct(), "claim_id", "left_anti").unionByName(rows)


# Event kinds that a projection follows.
CLAIM_EVENTS = ["claim.asserted", "claim.retracted"]
MERGE_EVENTS = ["entity.merged", "entity.merge_reverted"]
RELEVANT = [*CLAIM_EVENTS, *MERGE_EVENTS]
