"""Files, inline requests, blobs and record scans as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.functions.text import is_text_mime, mime_of

SKIPPED = r"(^|/)(\.git|node_modules|\.claimstead)(/|$)"
INLINE = "documents array<struct<relativePath: string, path: string, text: string, mimeType: string>>, relativePath string, path string, text string, mimeType string"


def files(spark: SparkSession, root: str, skipped: str = SKIPPED) -> DataFrame:
    """path (relative to root), content, mime, length of all files below root, without skipped folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") if ":" in root else "/" + root.strip("/")
    relative = F.when(plain == base, F.element_at(F.split(plain, "/"), -1)).otherwise(F.substring(plain, F.lit(len(base) + 2), F.length(plain)))
    named = found.select(relative.alias("path"), "content", "length").where(~F.col("path").rlike(skipped))
    return named.withColumn("mime", mime_of(F.col("path")))


def decoded(rows: DataFrame) -> DataFrame:
    """text: the decoded content of text types, else the path."""
    return rows.withColumn("text", F.when(is_text_mime(F.col("mime")), F.decode("content", "UTF-8")).otherwise(F.col("path")))


def inline_documents(bodies: DataFrame, body: str = "body") -> DataFrame:
    """path, text, mime of JSON bodies: a documents array, or one object; items without text are dropped."""
    parsed = bodies.withColumn("_b", F.from_json(body, INLINE))
    one = F.array(F.struct("_b.relativePath", "_b.path", "_b.text", "_b.mimeType"))
    items = parsed.select(F.explode(F.coalesce("_b.documents", one)).alias("d")).where("d.text IS NOT NULL")
    return items.select(F.coalesce("d.relativePath", "d.path", F.lit("untitled.txt")).alias("path"), F.col("d.text").alias("text"), F.coalesce("d.mimeType", F.lit("text/plain")).alias("mime"))


def dispatch(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """Documents of ingest requests (body, path): inline beats path, and an empty path is inline.

    The folders are asked for in one scan of all of them, so the plan doesn't grow with the requests. A folder asked for twice is read once.
    """
    documents = inline_documents(requests.where("body IS NOT NULL OR coalesce(path, '') = ''"))
    # a scan takes its folders from the driver: one short text for each request that names one
    roots = sorted({r["path"] for r in requests.where("body IS NULL AND coalesce(path, '') <> ''").select("path").distinct().collect()})
    if not roots:
        return documents
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    bases = ["/" + (r.split(":", 1)[-1] if ":" in r else r).strip("/") for r in roots]
    base = F.array_max(F.filter(F.lit(bases), lambda b: (plain == b) | F.startswith(plain, F.concat(b, F.lit("/")))))
    relative = F.when(plain == base, F.element_at(F.split(plain, "/"), -1)).otherwise(F.substring(plain, F.length(base) + 2, F.length(plain)))
    named = found.select(relative.alias("path"), "content").where(~F.col("path").rlike(SKIPPED))
    return documents.unionByName(decoded(named.withColumn("mime", mime_of(F.col("path")))).select("path", "text", "mime"))


def new_objects(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Objects (uri, content_hash) that weren't ingested with this content yet."""
    return listing.join(known.select("uri", "content_hash"), ["uri", "content_hash"], "left_anti")


def scan(rows: DataFrame, tenant: str, namespace: str | None = None) -> DataFrame:
    """Rows of a tenant and perhaps a namespace; a partition filter where the table is laid out by them."""
    own = rows.where(F.col("tenant_id") == tenant)
    return own if namespace is None else own.where(F.col("namespace_id") == namespace)


def lookup(ids: DataFrame, rows: DataFrame, id_: str) -> DataFrame:
    return ids.join(rows, id_, "left")


def evidence_content(evidence: DataFrame, blobs: DataFrame) -> DataFrame:
    """Evidence with its blob; text for text types only."""
    held = evidence.join(blobs.select("blob_key", "content", "content_type"), "blob_key", "left")
    return held.withColumn("text", F.when(F.col("content_type").startswith("text/"), F.decode("content", "UTF-8")))


def landed_requests(spark: SparkSession, folder: str, schema: str = "kind string, body string, path string") -> DataFrame:
    """Requests of a landing folder as a stream: each file once, by checkpoint."""
    return spark.readStream.schema(schema).json(folder)
