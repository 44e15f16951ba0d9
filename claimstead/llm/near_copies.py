"""Near copies by Jaccard similarity of word shingles: candidates by SimHash balls and by least shingles, verified on the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced, small, texts
from .components import connected_components
from .simhash import ball_links, print_of, shingles

#: Bands of least shingles and shingles in each: at a similarity of 0.8 two texts share a band with probability 0.9996.
BANDS, ROWS = 20, 5

#: Orders of texts by a hash; a band's leader is the least of its holders in the band's order, so a text meets several leaders of its family.
ORDERS = 5

#: Pairs of one leader that one row of its text serves; a leader of more is dealt out by a hash.
LEADER_PAIRS = 500

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """Signed 64-bit keys of the bands of a set of shingle hashes; a text without words has one key of its own."""
    if not len(hashes):
        return [0]
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[i : i + 4096, None] ^ _MASKS) * _FACTORS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(t, width) for t in texts(batch)]
            prints = np.array([print_of(h) for h in found], np.uint64).view(np.int64)
            keys = pa.array([bands(np.unique(h)) for h in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(prints), keys], ["doc_id", "tie", "print", "bands"])

    return run


def _similar(width: int, least: float):
    """The pairs u, v of those given with their texts whose sets of shingles have a Jaccard similarity of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.empty(0, np.uint64)
        for batch in batches:
            good = []
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if u != leader:
                    leader, own = u, np.unique(shingles(a.as_py(), width))
                other = np.unique(shingles(b.as_py(), width))
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(both >= least * (len(own) + len(other) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def near_copy_components(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """doc_id, tie (a hash of the text) and root (the least tie that links reach), a row per row of docs.

    Links are pairs of texts whose sets of shingles of `width` words have a Jaccard similarity of `least` or more, verified on the
    texts. Candidates share a SimHash ball of `radius` bits or a band of least shingles. Holders of a band are held against one
    of them, not against each other, so a pair is missed where it has no band in common, or in each only third texts as
    leaders that are unlike one of the two; bands have ORDERS different orders to choose a leader by, so a family has several. Texts are read twice; only those of candidates are shuffled. Texts without words are
    equal; an empty table gives an empty result. Ids play no part, so null and repeated ids are rows like others; repeated rows share a tie and so a root; very long texts are shingled whole.
    """
    tied = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sketches = cut(tied.mapInArrow(_sketches(width), "doc_id long, tie long, print long, bands array<long>"))
    nodes = cut(sketches.select("tie", "print", "bands").dropDuplicates(["tie"]))
    by_print = cut(nodes.groupBy("print").agg(F.min("tie").alias("m")))
    same = nodes.join(by_print, "print").select(F.col("m").alias("u"), F.col("tie").alias("v"))
    one = by_print.select(F.col("print").alias("a"), F.col("m").alias("u"))
    two = by_print.select(F.col("print").alias("b"), F.col("m").alias("v"))
    balls = ball_links(nodes.select("print"), radius).join(one, "a").join(two, "b").select("u", "v")
    keyed = nodes.select("tie", F.posexplode("bands").alias("band", "key")).withColumn("order", F.xxhash64("tie", F.col("band") % ORDERS))
    first = keyed.groupBy("key").agg(F.min(F.struct("order", "tie")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = cut(first.select("key", F.col("m.tie").alias("m")))
    banded = keyed.join(leaders, "key").select(F.col("m").alias("u"), F.col("tie").alias("v"))
    # u stays the leader, as only its rows are dealt out
    pairs = cut(same.union(balls).union(banded).where("u <> v").distinct())
    ends = pairs.select(F.explode(F.array("u", "v")).alias("tie")).distinct()
    held = cut(tied.select("tie", "text").join(ends, "tie", "left_semi").dropDuplicates(["tie"]))
    many = cut(pairs.groupBy("u").count().where(F.col("count") > LEADER_PAIRS).select("u", F.ceil(F.col("count") / LEADER_PAIRS).cast("int").alias("parts")))
    many = small(many)
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(many, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"))
    first = held.select(F.col("tie").alias("u"), F.col("text").alias("a")).join(many, "u", "left").select("u", "a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    second = held.select(F.col("tie").alias("v"), F.col("text").alias("b"))
    links = dealt.join(second, "v").join(first, ["u", "part"]).select("u", "v", "a", "b").mapInArrow(_similar(width, least), "u long, v long")
    roots = cut(connected_components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    return sketches.join(roots, F.col("tie") == F.col("node"), "left").select("doc_id", "tie", F.coalesce("root", "tie").alias("root"))
