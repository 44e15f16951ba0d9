"""Memories of principals: recorded by writers that may, searched by readers that may."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.scope import access_reason
from claimstead.operators.identity import small
from claimstead.operators.records import memories


def search(held: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """query_id and the columns of the memories that have the question's text, in any case, and that its reader may read; an empty or null text finds all.

    held: body and a resource's scope; questions: query_id, text, reader. A stated set of questions against all rows: questions are broadcast while they are few.
    """
    asked = small(questions.select("query_id", F.lower(F.coalesce("text", F.lit(""))).alias("_q"), F.col("reader").alias("_p")))
    found = held.join(asked, F.contains(F.lower(F.coalesce("body", F.lit(""))), F.col("_q")) & (F.col("tenant_id") == F.col("_p.tenant_id")))
    resource = F.struct("tenant_id", "namespace_id", "classification", "visibility", "owner_id")
    given = F.struct(F.col("_p.tenant_id").alias("tenant_id"), now.alias("now"), F.lit(None).cast("string").alias("purpose"), F.lit(None).cast("struct<delegator_id: string, scope: array<string>, expires_at: timestamp_ntz, purpose: string>").alias("delegation"))
    return found.where(access_reason(F.col("_p"), F.lit("memory.read"), resource, given) == "ALLOW").drop("_q", "_p")


def record(rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Memory rows of those whose writer may write them, with ids, and the others with their reason. rows: request_id, writer, owner_id, kind, body and a resource's scope."""
    given = F.struct(F.col("writer.tenant_id").alias("tenant_id"), now.alias("now"), F.lit(None).cast("string").alias("purpose"), F.lit(None).cast("struct<delegator_id: string, scope: array<string>, expires_at: timestamp_ntz, purpose: string>").alias("delegation"))
    resource = F.struct("tenant_id", "namespace_id", "classification", "visibility", "owner_id")
    marked = rows.withColumn("reason", access_reason(F.col("writer"), F.lit("memory.write"), resource, given))
    return memories(marked.where("reason = 'ALLOW'").drop("reason", "writer"), now), marked.where("reason <> 'ALLOW'").select("request_id", "reason")
