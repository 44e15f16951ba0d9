"""A corpus pipeline: quality classifier, line dedup, SimHash near-dedup, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. Rows keep their doc_id; texts that line dedup changes get their new n_chars.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.llm.common import cut, fold, labels, shared_folder, word_count
from claimstead.llm.line_dedup import line_dedup
from claimstead.llm.mixing import pareto_mix
from claimstead.llm.near_copies import near_copy_components
from claimstead.llm.packing import pack_documents
from claimstead.llm.quality_classifier import document_statistics, keep, learn

#: Score from which the quality classifier keeps a document, and the folds it learns from.
KEEP_FROM, FOLDS = 0.3, 5


def _set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage uses, and all others in one, so that no name of theirs meets one that an operator adds."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)).alias("_set_aside"))


def _restored(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in used else F.col("_set_aside")[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is KEEP_FROM or more; the classifier learns from labels outside the held-out fold.

    Texts are read twice, whole, and never shuffled. Null and empty texts are scored like others; repeated rows get one score and stay or go together;
    a null doc_id has no label; extra columns are kept. Without labels every document stays; an empty table stays empty.
    """
    truth = labels(spark, sf_dir).where(fold("doc_id", FOLDS) != 0).select("doc_id", "quality")
    return keep(docs, learn(document_statistics(docs), truth), KEEP_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of 50 words or more; documents of which a fifth of the words or less is left go.

    Whole texts are compared, however long; null and short texts stay as they are; rows with equal doc_id and text count as one document and
    get the same result; a changed text gets its new n_chars, if there is such a column; extra columns are kept. An empty table stays empty.
    """
    used = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    out = line_dedup(_set_aside(docs, *used))
    if "n_chars" in used:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    left = word_count(F.col("text"))
    return _restored(out.where((F.col("n_removed") == 0) | (4 * left > F.col("n_removed"))), docs, *used)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word Jaccard of 0.8 or more): that with the least doc_id, null last, then with the least hash of its text; of equal rows one.

    Whole texts are compared; all texts without words, null ones too, are one component. Extra columns are kept; an empty table stays empty.
    """
    found = cut(near_copy_components(docs))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("x"))
    chosen = first.select(F.col("x.doc_id").alias("_id"), F.col("x.tie").alias("_of"))
    tied = _set_aside(docs, "doc_id", "text").withColumn("_tie", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = tied.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_of")), "left_semi")
    if not found.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_tie"])
    return _restored(kept, docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: rows of it are repeated.

    Null texts and texts without words have no size and are never taken; the null source is a source; equal rows are taken alike;
    long texts count whole; extra columns are kept. An empty table stays empty.
    """
    used = ("doc_id", "text", "source")
    mixed = pareto_mix(_set_aside(docs, *used)).where("copies > 0")
    return _restored(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, *used)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens; texts of any length are cut whole, null and empty ones are a single end, and repeated rows are packed each.

    Extra columns are not read. An empty table gives no piece.
    """
    import public_tokenizers as public

    return pack_documents(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Classifier, SimHash and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage gives is written below the shared folder and read again by the next."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
