"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.operators.identity import settle, shared_folder

__all__ = ["WORD", "cut", "documents", "fold", "labels", "shared_folder", "sliced", "small", "texts", "unit", "word_count"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a side table up to which a broadcast is asked for; beyond it Spark picks the join.
BROADCAST_ROWS = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    return settle(df)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a side table for broadcast if it has at most BROADCAST_ROWS rows; else leave the join to Spark."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the key and the salt alone, equal on every engine that has MD5."""
    head = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(salt)).cast("binary")), 1, 12)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 48)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch; null becomes the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows and, but for single longer texts, about `size` bytes, so that a worker's memory doesn't depend on Spark's batches."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 1):
            held += n
            if i - start >= rows or held >= size:
                yield batch.slice(start, i - start)
                start, held = i, 0
        if start < batch.num_rows:
            yield batch.slice(start)
