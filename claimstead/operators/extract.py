"""Documents to evidence, entities, claims and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.functions.text import claim_text, hash_embedding, normal_predicate
from claimstead.operators import records
from claimstead.operators.temporal import later_conflicts

VERB = r"(?i)(^|[^A-Za-z0-9_])(is|are|was|were)($|[^A-Za-z0-9_])"


def evidence(docs: DataFrame, *also: str) -> DataFrame:
    """Content-addressed evidence of (path, content, mime): hash, key and row id, and columns named besides."""
    digest = F.sha2(F.col("content"), 256)
    return docs.select(*also, F.sha2(F.concat_ws("\u0001", "path", digest), 256).alias("evidence_id"), F.col("path").alias("uri"), digest.alias("content_hash"), F.concat(F.lit("evidence/"), digest, F.lit("/"), F.col("path")).alias("blob_key"), "mime")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, place, sentence: split at white space behind a full stop, exclamation or question mark."""
    marked = F.regexp_replace("text", r"([.!?])[ \t\n\r\f]+", "$1\u0001")
    return docs.select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("place", "sentence")).where("sentence <> ''")


def drafts(docs: DataFrame) -> DataFrame:
    """doc_id, place, subject_label, predicate, object_value, confidence: the first is/are/was/were of a sentence parts subject and object; each document also mentions its beginning."""
    said = sentences(docs).where(F.col("sentence").rlike(VERB))
    both = F.split(F.regexp_replace("sentence", r"(?is)^(.*?)(^|[^A-Za-z0-9_])(is|are|was|were)($|[^A-Za-z0-9_])", "$1$2\u0001$4"), "\u0001", 2)
    parts = said.select("doc_id", "place", F.trim(F.get(both, F.lit(0))).alias("subject_label"), F.lit("is").alias("predicate"), F.trim(F.get(both, F.lit(1))).alias("object_value"), F.lit(0.8).alias("confidence"))
    mention = docs.select("doc_id", F.lit(-1).alias("place"), F.lit("document").alias("subject_label"), F.lit("mentions").alias("predicate"), F.substring("text", 1, 80).alias("object_value"), F.lit(1.0).alias("confidence"))
    return parts.unionByName(mention)


def ingest(docs: DataFrame, tenant: str, namespace: str, dimensions: int = 16) -> dict[str, DataFrame]:
    """evidence, entities, claims (with later conflicts marked), embeddings, events and outbox of documents (doc_id, text, recorded_at).

    Entities are keyed by tenant, namespace and lower-cased label, so runs agree; nothing is written row by row.
    """
    made = drafts(docs).join(docs.select("doc_id", "recorded_at"), "doc_id")
    entity = F.sha2(F.concat_ws("\u0001", F.lit(tenant), F.lit(namespace), F.lower(F.trim("subject_label"))), 256)
    made = made.withColumn("subject_id", entity).withColumn("predicate", normal_predicate(F.col("predicate")))
    made = made.withColumn("claim_id", F.sha2(F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col("place").cast("string")), 256)).withColumn("status", F.lit("asserted"))
    first = made.groupBy("subject_id").agg(F.min(F.struct("doc_id", "place", F.trim("subject_label").alias("label"))).alias("f"))
    entities = first.select(F.col("subject_id").alias("entity_id"), "f.label")
    claims = later_conflicts(made).select("claim_id", "doc_id", "subject_id", "predicate", "object_value", "confidence", "status", "recorded_at")
    text = claim_text(F.col("predicate"), F.col("object_value"), F.col("subject_id"))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    proof = evidence(docs.select(path.alias("path"), F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("mime"), "recorded_at"), "recorded_at")
    log = [records.events(proof, "evidence.ingested", "evidence_id", F.col("recorded_at")), records.events(claims, "claim.asserted", "claim_id", F.col("recorded_at"))]
    log = log[0].unionByName(log[1])
    return {"evidence": proof, "entities": entities, "claims": claims, "embeddings": claims.select("claim_id", hash_embedding(text, dimensions).alias("vector")), "events": log, "outbox": log.select("event_id")}


def reextract(evidence_ids: DataFrame, evidence_: DataFrame, blobs: DataFrame) -> DataFrame:
    """Drafts of stored evidence; ids without evidence or blob are skipped."""
    held = evidence_.join(evidence_ids, "evidence_id", "left_semi").join(blobs.select("blob_key", "content"), "blob_key")
    return drafts(held.select(F.col("evidence_id").alias("doc_id"), F.decode("content", "UTF-8").alias("text")))
