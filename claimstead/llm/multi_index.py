"""Approximate nearest neighbours by an inverted multi-index: two quantised halves, centroid pairs in the order of their summed nearness, entries reranked exactly."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Vectors that centroids are fitted on, and queries that the share to read is measured on, in expectation; centroids a half at most.
FIT, PROBED, CENTROIDS = 20_000, 128, 1024
#: Vectors and queries of one unit of work at most, in expectation.
VECTORS, QUERIES = 4096, 2048
#: Share of the measured queries' neighbours that must be found.
RECALL = 0.95


@dataclass(frozen=True)
class MultiIndex:
    """vectors: vec_id, vector, i, j, the halves' nearest centroids; first and second: centroids of the halves; counts: entries of each pair of centroids."""

    vectors: DataFrame
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector as doubles: rows with an id whose vector has no null or non-finite component and isn't zero, one a vec_id (of several the greatest vector), of the commonest width (of equally common ones the greatest)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0.0))
    v = cut(v.groupBy("vec_id").agg(F.max("vector").alias("vector")))
    widths = v.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return v.where(F.size("vector") == (widths["width"] if widths else 0))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width as a matrix, without a Python object a number."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)


def _drawn(key: str, share: float, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def _centroids(vectors: DataFrame, n: int, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves by k-means over about FIT vectors drawn by a hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    half = width // 2
    drawn = cut(vectors.where(_drawn("vec_id", FIT / n, "fit")))
    drawn = drawn if not drawn.isEmpty() else cut(vectors.limit(1))
    found = []
    for start, size in ((1, half), (half + 1, width - half)):
        part = drawn.select(array_to_vector(F.slice("vector", start, size)).alias("features")).cache()
        found.append(np.array(KMeans(k=k, seed=7, maxIter=8, initSteps=1).fit(part).clusterCenters()) if size else np.zeros((1, 0)))
        part.unpersist()
    return found[0], found[1]


def build(vectors: DataFrame, centroids: int | None = None) -> MultiIndex:
    """Index of all usable vectors. Each half has five times the fourth root of n centroids, at most CENTROIDS, fitted on a bounded sample: 25 roots of n pairs, so a walk over pairs grows slower than n."""
    good = cut(usable(vectors))
    n = good.count()
    if not n:
        return MultiIndex(good.withColumns({"i": F.lit(0), "j": F.lit(0)}), np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((1, 1), np.int64))
    width = len(good.first()["vector"])
    first, second = _centroids(good, n, centroids or max(1, min(CENTROIDS, round(5 * n**0.25))), width)
    held = vectors.sparkSession.sparkContext.broadcast((first, second))  # 2 x CENTROIDS x half a vector at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = held.value
        for b in batches:
            x = _matrix(b.column("vector"), width)
            codes = [pa.array(_nearest(x[:, : width // 2], one).astype(np.int32)), pa.array(_nearest(x[:, width // 2 :], two).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *codes], ["vec_id", "vector", "i", "j"])

    coded = cut(good.mapInArrow(run, "vec_id long, vector array<double>, i int, j int"))
    counts = np.zeros((len(first), len(second)), np.int64)
    for r in coded.groupBy("i", "j").count().collect():  # a number a pair of centroids, so bounded by their square
        counts[r["i"], r["j"]] = r["count"]
    return MultiIndex(coded, first, second, counts)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """How far a query goes in each row of the index: for every first centroid how many second ones, in the order of their nearness, it visits.

    first, second: the query's nearness to the centroids of the halves. Pairs are taken by falling sum from a heap, which holds for each row
    that has been begun the next pair of it, until they hold `most` entries. A pair goes in when the pair above it has gone out, so
    of each row a beginning is visited.
    """
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[rows].tolist(), second[columns].tolist()
    depth = [0] * len(a)
    heap, left = [(-(a[0] + b[0]), 0, 0)], most
    while heap and left > 0:
        _, r, s = heapq.heappop(heap)
        depth[r] = s + 1
        left -= int(counts[rows[r], columns[s]])
        if s + 1 < len(b):
            heapq.heappush(heap, (-(a[r] + b[s + 1]), r, s + 1))
        if s == 0 and r + 1 < len(a):
            heapq.heappush(heap, (-(a[r + 1] + b[0]), r + 1, 0))
    found = np.zeros(len(a), np.int64)
    found[rows] = depth
    return found


HITS = "query_id long, vec_id long, score double"


def search(index: MultiIndex, queries: DataFrame, k: int, most: int) -> DataFrame:
    """query_id, vec_id, score: of each query its k nearest among about `most` entries or more of the pairs that it visits, but itself.

    queries: query_id, vector, of the index's width. A query is sent to the rows (first centroids) that it visits with how far it goes there; the vectors of a
    row are dealt into blocks, and the queries that visit it too, so a unit of work is bounded however many copies a row holds and however many
    queries want it. A unit gives the k best of each query, so what is shuffled last is k rows a unit and query.
    """
    width = index.first.shape[1] + index.second.shape[1]
    held = queries.sparkSession.sparkContext.broadcast((index.first, index.second, index.counts))
    half = index.first.shape[1]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, counts = held.value
        for b in batches:
            x = _matrix(b.column("vector"), width)
            ids = b.column("query_id").to_numpy(zero_copy_only=False)
            one, two = x[:, :half] @ first.T, x[:, half:] @ second.T
            for at in range(len(ids)):
                depth = traverse(one[at], two[at], counts, most)
                rows = np.flatnonzero(depth)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), ids[at])), pa.array(rows.astype(np.int32)), pa.array(depth[rows].astype(np.int32))], ["query_id", "i", "depth"])

    visited = cut(queries.select("query_id", "vector").mapInArrow(visits, "query_id long, i int, depth int"))
    wanted = {r["i"]: r["count"] for r in visited.groupBy("i").count().collect()}  # a number a first centroid
    spread = lambda sizes, most_: F.coalesce(F.get(F.lit([max(1, -(-int(sizes.get(i, 0)) // most_)) for i in range(len(index.first))]), F.col("i")), F.lit(1))
    parts, shares = spread(dict(enumerate(index.counts.sum(axis=1).tolist())), VECTORS), spread(wanted, QUERIES)
    v = index.vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), shares - 1)))
    asked = visited.join(queries.select("query_id", F.col("vector").alias("asked")), "query_id").withColumn("qb", F.pmod(F.xxhash64("query_id", F.lit("q")), shares).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), parts - 1)))
    unit = ["i", "vb", "qb"]

    def rerank(vectors: pa.Table, asked_: pa.Table) -> pa.Table:
        _, second, _ = held.value
        if not vectors.num_rows or not asked_.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, own, j = _matrix(vectors.column("vector"), width), vectors.column("vec_id").to_numpy(), vectors.column("j").to_numpy()
        q, ids, depth = _matrix(asked_.column("asked"), width), asked_.column("query_id").to_numpy(), asked_.column("depth").to_numpy()
        # the place of every second centroid in the query's order
        near = np.argsort(np.argsort(-(q[:, half:] @ second.T), axis=1, kind="stable"), axis=1)
        scores = np.full((len(ids), len(own)), -np.inf)
        order = np.argsort(j, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(j[order]) > 0, True])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            members = order[a:b]
            who = np.flatnonzero(near[:, j[members[0]]] < depth)
            if len(who):
                scores[np.ix_(who, members)] = q[who] @ x[members].T
        scores[ids[:, None] == own[None, :]] = -np.inf
        found = [(np.full(len(best[0]), ids[n]), *best) for n in range(len(ids)) if len((best := _finite(own, scores[n], k))[0])]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.array([], t) for t in (np.int64, np.int64, float)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return v.groupBy(*unit).cogroup(asked.groupBy(*unit)).applyInArrow(rerank, HITS)


def _finite(own: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, first those of a partial sort and all that tie with the last of it; entries that weren't visited are left out."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero((scores >= least) & np.isfinite(scores))
    else:
        some = np.flatnonzero(np.isfinite(scores))
    best = some[np.lexsort((own[some], -scores[some]))[:k]]
    return own[best], scores[best]


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best hits of each query, ties to the smaller vec_id."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (F.col("score") + 0.0).alias("score"))


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best of each batch of vectors: a bounded set of queries against all vectors."""
    asked = queries.select("query_id", "vector").toPandas()
    held = queries.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(np.int64), np.array(asked["vector"].tolist(), float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        for b in batches if len(ids) else ():
            own = b.column("vec_id").to_numpy(zero_copy_only=False)
            scores = q @ _matrix(b.column("vector"), q.shape[1]).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            for n in range(len(ids)):
                best = _finite(own, scores[n], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best[0]), ids[n])), pa.array(best[0]), pa.array(best[1])], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "vector").mapInArrow(run, HITS)


def tuned(index: MultiIndex, k: int, recall: float = RECALL) -> int:
    """Entries to visit so that about PROBED vectors, drawn by a hash, find `recall` of their k nearest.

    Their nearest are told exactly; for each of those the entries that its query has visited once it comes to the neighbour's pair are counted, and `most` is what
    that share of neighbours needs. Vectors without clusters need many.
    """
    n = int(index.counts.sum())
    drawn = cut(index.vectors.where(_drawn("vec_id", PROBED / max(n, 1), "probe")).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked")))
    truth = ranked(exact(index.vectors, drawn.withColumnRenamed("asked", "vector"), k), k).select("query_id", "vec_id")
    found = truth.join(index.vectors.select("vec_id", "i", "j"), "vec_id").join(drawn, "query_id")
    held = drawn.sparkSession.sparkContext.broadcast((index.first, index.second, index.counts))
    half = index.first.shape[1]

    def needs(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second, counts = held.value
        q = np.array(pdf["asked"].iat[0], float)
        order = np.argsort(-((first @ q[:half])[:, None] + (second @ q[half:])[None, :]), axis=None, kind="stable")
        before = np.empty(counts.size, np.int64)
        before[order] = np.cumsum(counts.ravel()[order])
        return pd.DataFrame({"need": before[pdf["i"].to_numpy() * counts.shape[1] + pdf["j"].to_numpy()]})

    need = found.groupBy("query_id").applyInPandas(needs, "need long").toPandas()["need"].to_numpy()  # PROBED x k numbers
    return int(np.quantile(need, recall, method="higher")) if len(need) else n


def nearest(vectors: DataFrame, queries: Column, k: int = 20, recall: float = RECALL, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that `queries` names the k nearest of all others by inner product, as found by the index, tuned to `recall`.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id or of another width than the commonest; rows with
    one vec_id count once. With k or fewer candidates all are returned. An empty table gives no rows.
    """
    index = build(vectors, centroids)
    most = tuned(index, k, recall)
    asked = cut(index.vectors.where(queries).select(F.col("vec_id").alias("query_id"), "vector"))
    return ranked(search(index, asked, k, most), k)


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others, 20 each."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
