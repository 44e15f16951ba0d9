"""SimHash near-duplicates, found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, sliced, small, texts
from .components import connected_components

#: Seed of the shingle hash.
SEED = 42

#: Variants that one group of the ball join holds on average at most.
VARIANTS_PER_GROUP = 2_000_000

#: Further bits that a bucket of over twice as many variants is dealt by.
DEAL_BITS = 6


def shingles(text: str, width: int) -> np.ndarray:
    """Hashes of the word shingles of a text, A-Z lower-cased, with repeats; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1)[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)], np.uint64, len(stops))


def print_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes; none have 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; repeats count; a text without words has 0."""
    return print_of(shingles(text, width))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints = np.array([fingerprint(t, width) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(prints)], ["doc_id", "tie", "print"])

    return run


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of at most radius of the lowest `bits` bits."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.uint64)


def _scatter(start: int, stop: int, half: int):
    """Rows (bucket, print) of buckets told by the first `start` bits, dealt by the first `stop`: a print goes to each bucket that some variant of it falls in."""
    step = np.uint64(stop - start)
    heads = [ball(stop - start, left) for left in range(half + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            at = batch.column("bucket").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), 4096):
                part, bucket = every[i : i + 4096], at[i : i + 4096]
                spent = np.bitwise_count((part >> np.uint64(64 - start)) ^ bucket) if start else np.zeros(len(part), np.uint8)
                own = (part >> np.uint64(64 - stop)) & np.uint64((1 << (stop - start)) - 1)
                for left in range(half + 1):
                    some = spent == half - left
                    dealt = ((bucket[some] << step) | own[some])[:, None] ^ heads[left][None, :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(dealt.ravel().view(np.int64)), pa.array(np.repeat(part[some], len(heads[left])).view(np.int64))], ["bucket", "print"]
                    )

    return run


def _collide(prefix: int, half: int):
    """Links between prints of one bucket that have a variant in common: each holder of a variant with the least holder."""
    tails = {r: ball(64 - prefix, r) for r in range(half + 1)}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        prints = np.unique(table.column("print").to_numpy().view(np.uint64))
        spent = np.bitwise_count((prints >> np.uint64(64 - prefix)) ^ np.int64(key[0].as_py()).view(np.uint64))
        low = prints & np.uint64((1 << (64 - prefix)) - 1)
        variants, owners = [], []
        for r in range(half + 1):
            own = np.flatnonzero(spent == half - r)
            variants.append((low[own][:, None] ^ tails[r][None, :]).ravel())
            owners.append(np.repeat(own, len(tails[r])))
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variant, kind="stable")
        variant, owner = variant[order], owner[order]
        new = np.r_[True, variant[1:] != variant[:-1]]
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(owner, np.flatnonzero(new)) if len(owner) else owner
        first = least[group] if len(owner) else owner
        pairs = np.unique(np.stack([first, owner], 1)[first != owner], axis=0)
        # holders of one variant are within twice the half radius; the distance is verified all the same
        a, b = prints[pairs[:, 0]], prints[pairs[:, 1]]
        good = np.bitwise_count(a ^ b) <= 2 * half
        return pa.table({"a": a[good].view(np.int64), "b": b[good].view(np.int64)})

    return run


def ball_links(prints: DataFrame, radius: int = 4, variants_per_group: int = VARIANTS_PER_GROUP) -> DataFrame:
    """Links a, b between distinct prints that differ in at most `radius` (even) bits, enough of them to connect all such pairs.

    Every print has all its variants within half the radius; two prints are within the radius if and only if they share a variant.
    Variants are dealt out by their first bits, so a print travels once to each bucket that a variant of it falls in, and the
    variants of a bucket are spelt out there. The number of prefix bits follows the number of prints; buckets that hold more than
    twice `variants_per_group` variants all the same, as families of near copies make them, are dealt further by the next DEAL_BITS
    bits until none does. Each variant has one bucket, so dealing loses no pair, and at 64 bits a bucket is one variant.
    Holders of a variant are linked to the least of them, not to each other: all of them are within the radius, so no component is lost.
    """
    half = radius // 2
    distinct = cut(prints.select("print").distinct())
    n = distinct.count()
    size = len(ball(64, half))
    prefix = next((b for b in range(6, 25, 2) if n * size <= variants_per_group << b), 24)
    rows = "bucket long, print long"
    spread = distinct.select(F.lit(0).cast("long").alias("bucket"), "print").mapInArrow(_scatter(0, prefix, half), rows)
    links = None
    while True:
        # a print has spent the bits in which its bucket differs from it; the rest of the radius goes to the bits behind the prefix
        spent = F.bit_count(F.shiftrightunsigned("print", 64 - prefix).bitwiseXOR(F.col("bucket")))
        spelt = F.get(F.array(*[F.lit(len(ball(64 - prefix, half - k))) for k in range(half + 1)]), spent)
        hot = cut(spread.groupBy("bucket").agg(F.sum(spelt).alias("variants")).where(F.col("variants") > 2 * variants_per_group).select("bucket")) if prefix < 64 else None
        many = hot.count() if hot is not None else 0
        cool = spread.join(small(hot, many), "bucket", "left_anti") if many else spread
        found = cool.groupBy("bucket").applyInArrow(_collide(prefix, half), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not many:
            return links.distinct()
        deeper = min(prefix + DEAL_BITS, 64)
        spread = cut(spread.join(small(hot, many), "bucket", "left_semi").select("bucket", "print").mapInArrow(_scatter(prefix, deeper, half), rows))
        prefix = deeper


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, tie (a hash of the text), print (the fingerprint as a signed long), root and component_id, a row per row of docs.

    component_id is the least doc_id that links of at most `radius` bits reach, root the least print. Texts are read once and never
    shuffled; only fingerprints are. Null texts count as empty and have fingerprint zero, which links like any other; rows with one
    doc_id are separate documents; a component whose ids are all null has a null component_id. Very long texts are shingled whole, repeats included. An empty table gives an empty result.
    """
    tied = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"), "text")
    prints = cut(tied.mapInArrow(_fingerprints(width), "doc_id long, tie long, print long"))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = connected_components(ball_links(prints, radius))
    grouped = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    grouped = cut(grouped)
    # scans of their own, so that Spark can split the other side where one component has very many fingerprints
    ids = cut(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    table = cut(grouped.join(ids, "root").select(F.col("print").alias("_print"), "root", "component_id"))
    return prints.join(table, F.col("print") == F.col("_print")).select("doc_id", "tie", "print", "root", "component_id")


def op7_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
