"""Packing documents into training windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, sliced, texts
from .pretokens import Ids, packed

#: Pieces shorter than a window that one task packs on average.
PIECES_PER_GROUP = 50_000


class Windows:
    """Open windows in a segment tree over remaining capacity; tightest(n) is the least capacity of at least n that some window has left."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        if len(self.open[room]) == 1:
            self._mark(room, 1)

    def take(self, room: int) -> int:
        window = self.open[room].pop()
        if not self.open[room]:
            self._mark(room, -1)
        return window

    def _mark(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        i, count = need + self.leaves, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length; lengths come in decreasing order and none is over size."""
    windows, at, offsets, used = Windows(size), [], [], 0
    for n in lengths:
        room = windows.tightest(n)
        if room is None:
            window, room = used, size
            used += 1
        else:
            window = windows.take(room)
        at.append(window)
        offsets.append(size - room)
        if room > n:
            windows.put(room - n, window)
    return at, offsets


def _pieces(path: str, ranks_path: str, pattern: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(path, ranks_path, pattern)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = ids_of.encode(text)
                ids.append(end)
                # told by the whole document, so that rows with one doc_id stay apart
                data, whole = memoryview(packed(ids)), len(ids)
                tie = zlib.crc32(data)
                rows += [(doc_id, tie, at, min(size, whole - at), zlib.crc32(data[4 * at : 4 * (at + size)]), whole) for at in range(0, whole, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 6, ["doc_id", "tie", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(size: int, groups: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "tie", "start"], ascending=[False, True, True, True], kind="stable")
        window, offset = best_fit_decreasing(pieces["length"].tolist(), size)
        # group g numbers its windows g, g + groups, ...: unique without counting other groups'
        pieces = pieces.assign(sequence_id=np.array(window, np.int64) * groups + key[0], offset=np.array(offset, np.int64))
        return pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack_documents(docs: DataFrame, path: str, ranks_path: str, pattern: str, end: int = 1, size: int = 2048, pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids with `end` behind are cut into full windows and a rest. Full windows are sequences of their own; rests are dealt by a hash
    into groups of about pieces_per_group, and each group is packed by best-fit decreasing, so no task sees all of them. Only the
    pieces' numbers are shuffled, never texts or ids.

    Null or empty texts are a single `end`. Rows with one doc_id are packed as separate documents. Pieces of equal length are taken by
    doc_id, then by a checksum of the document. A null doc_id is kept. An empty table gives an empty result; extra columns are not read.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(
        _pieces(path, ranks_path, pattern, end, size), "doc_id long, tie long, start long, length long, ids_crc32 long, doc_tokens long"
    )
    pieces = cut(pieces)
    rests = pieces.where(F.col("length") < size)
    groups = max(1, -(-rests.count() // pieces_per_group))
    # the rows' places on the checkpoint deal equal rows apart, however many there are of one
    of = F.pmod(F.xxhash64("doc_id", "tie", "start", F.monotonically_increasing_id()), F.lit(groups))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed_rests = rests.withColumn("_group", of).groupBy("_group").applyInPandas(_pack(size, groups), schema)
    full = pieces.where(F.col("length") == size)
    # full windows are numbered downwards from -1, by partition and place, on the checkpointed rows
    return packed_rests.unionByName(full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pack_documents(documents(spark, sf_dir), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
