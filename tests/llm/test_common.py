"""Shared helpers."""

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from claimstead.llm.common import fold, sliced, unit, word_count


def test_folds_units_and_words(spark):
    df = spark.createDataFrame([(0, "a b"), (12345, None), (None, " \t\x0b"), (-7, "é x y")], "doc_id long, text string")
    got = df.select("doc_id", fold("doc_id", 5).alias("f"), unit(F.col("doc_id"), "s").alias("u"), word_count(F.col("text")).alias("n")).collect()
    for r in got:
        assert r["f"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 and 0 < r["u"] < 1
    assert [r["n"] for r in got] == [2, 0, 0, 2]


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 5, None, "é" * 30, "", "a", "b", "c", "d", None])], ["doc_id", "text"])
    parts = list(sliced(iter([batch, batch.slice(0, 0)]), rows=3, size=20))
    assert [x for p in parts for x in p.column("doc_id").to_pylist()] == list(range(9)) and max(p.num_rows for p in parts) == 3 and len(parts) == 3
