"""Approximate vector search over navigable neighbour graphs: filters within the walk, which reads codes of a byte a dimension; only what it keeps is ranked by the vectors."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.operators.identity import settle
from claimstead.operators.fusion import top_k
from claimstead.operators.perspective import CLAIM, QUESTION, claim_columns, open_to, question_columns

#: Vectors of a graph and questions of a unit of work at most, in expectation; links that a node chooses, out of so many near ones; results that a walk keeps.
SHARD, BLOCK, LINKS, NEAR, KEPT = 20_000, 1024, 16, 64, 24
#: Nodes that a walk starts from, and nodes whose products with a whole shard are held at once.
STARTS, ROWS = 8, 64

INDEX = "shard int, claim_id long, tenant_id string, namespace_id string, valid_from long, valid_to long, recorded_at long, vector array<double>, code binary, scale double, node int, links array<int>"


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def neighbours(unit: np.ndarray, links: int = LINKS, near: int = NEAR) -> list[np.ndarray]:
    """Links of a graph over unit vectors: of its `near` nearest a node takes those that are nearer to it than to any taken before, then the next nearest, up to `links`.

    Every link is open both ways; a node keeps twice `links` of them, the nearest.
    """
    n = len(unit)
    near = min(near, n - 1)
    if near < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    close = np.empty((n, near), np.int64)
    for at in range(0, n, ROWS):  # so the table of products stays small
        part = unit[at : at + ROWS] @ unit.T
        part[np.arange(len(part)), np.arange(at, at + len(part))] = -np.inf
        np.negative(part, out=part)
        best = np.argpartition(part, near - 1, axis=1)[:, :near]
        close[at : at + ROWS] = np.take_along_axis(best, np.argsort(np.take_along_axis(part, best, axis=1), axis=1, kind="stable"), axis=1)
    taken: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        own = close[i]
        among, mine = unit[own] @ unit[own].T, unit[own] @ unit[i]
        chosen: list[int] = []
        for c in range(near):
            if len(chosen) == links:
                break
            if not chosen or (among[c, chosen] < mine[c]).all():
                chosen.append(c)
        rest = [c for c in range(near) if c not in set(chosen)]
        for c in own[chosen + rest[: links - len(chosen)]].tolist():
            taken[i].add(c)
            taken[c].add(i)
    out = []
    for i, both in enumerate(taken):
        all_ = np.array(sorted(both), np.int64)
        out.append(all_ if len(all_) <= 2 * links else np.sort(all_[np.argsort(-(unit[all_] @ unit[i]), kind="stable")[: 2 * links]]))
    return out


def build(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """INDEX: a graph for each shard of a tenant's vectors, so that a tenant's questions read no other's. vectors: claim_id, vector, CLAIM; unfit vectors (vector_fault) are left out by the caller.

    A tenant has as many shards as it has times `shard` vectors, dealt by a hash: a large tenant is spread, and no graph is larger than a task can hold.
    Write it once as a table; new vectors become shards of their own by build() on them alone, with other shard numbers.
    """
    width = vectors.agg(F.max(F.size("vector")).alias("w")).first()["w"] or 0
    sizes = settle(vectors.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_n")))
    dealt = vectors.select("claim_id", *claim_columns(), F.col("vector").cast("array<double>").alias("vector")).join(sizes, "tenant_id")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("claim_id"), F.ceil(F.col("_n") / shard)).cast("int")).drop("_n")

    def link(part: pa.Table) -> pa.Table:
        unit = _matrix(part.column("vector"), width)
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)
        columns = [part.column(c) for c in ("shard", "claim_id", *CLAIM)]
        links = neighbours(unit)
        scale = np.maximum(np.abs(unit).max(axis=1, initial=0.0), 1e-300) / 127
        codes = np.rint(unit / scale[:, None]).astype(np.int8)
        made = [pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * width), pa.array(unit.ravel())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(np.arange(len(unit), dtype=np.int32)), pa.array([x.tolist() for x in links], pa.list_(pa.int32()))]
        return pa.Table.from_arrays([*columns, *made], ["shard", "claim_id", *CLAIM, "vector", "code", "scale", "node", "links"])

    return dealt.select("shard", "claim_id", *CLAIM, "vector").groupBy("tenant_id", "shard").applyInArrow(link, INDEX)


def walk(codes: np.ndarray, links: list[np.ndarray], fits: np.ndarray, q: np.ndarray, k: int, kept: int) -> tuple[np.ndarray, int]:
    """The nodes kept, and how many codes were read: a best-first walk that goes through all nodes but keeps only those that fit.

    codes: a row a node, whose product with q orders them. The walk ends once the nearest node ahead is further than the last of `kept`; then it is widened to twice as
    many and goes on, until its k best have stayed the same. If it runs dry before, it starts anew from nodes not seen yet, until all are. Where so
    few nodes fit that a walk would read more, their codes are read and no others.
    """
    members = np.flatnonzero(fits)
    # a walk reads about kept * LINKS / 2 nodes over the share of nodes that fit
    if len(members) ** 2 <= kept * LINKS / 2 * len(codes) or len(codes) <= 2 * STARTS:
        near = codes[members] @ q
        return members[np.argsort(-near, kind="stable")[:kept]], len(members)
    seen, near_ = np.zeros(len(codes), bool), np.full(len(codes), -np.inf, np.float32)
    ahead: list[tuple[float, int]] = []
    best: list[float] = []

    def read(nodes: np.ndarray) -> None:
        seen[nodes] = True
        values = codes[nodes] @ q
        near_[nodes] = np.where(fits[nodes], values, -np.inf)
        for near, node, fit in zip(values.tolist(), nodes.tolist(), fits[nodes].tolist(), strict=True):
            heapq.heappush(ahead, (-near, node))
            if fit:
                if len(best) < kept:
                    heapq.heappush(best, near)
                elif near > best[0]:
                    heapq.heapreplace(best, near)

    def first(n: int) -> np.ndarray:
        n = min(n, len(near_) - 1)
        return np.argpartition(-near_, n)[:n]

    read(np.unique(np.linspace(0, len(codes) - 1, STARTS).astype(np.int64)))
    told: set[int] = set()
    while True:
        while ahead and not (len(best) == kept and -ahead[0][0] < best[0]):
            own = links[heapq.heappop(ahead)[1]]
            fresh = own[~seen[own]]
            if len(fresh):
                read(fresh)
        if seen.all():
            break
        if len(best) < kept:
            read(np.flatnonzero(~seen)[:STARTS])
            continue
        now = set(first(k).tolist())
        if now == told:
            break
        told, kept = now, 2 * kept
        best[:] = [v for v in near_[first(kept)].tolist() if v > -np.inf]
        heapq.heapify(best)
    found = first(kept)
    return found[np.isfinite(near_[found])], int(seen.sum())


HITS = "query_id long, claim_id long, score double, codes_read long, vectors_read long"


def search(index: DataFrame, questions: DataFrame, k: int, kept: int = KEPT, least: float = -2.0) -> DataFrame:
    """HITS: of every shard of a question's tenant its k nearest, by cosine to six digits, among the vectors in the question's perspective.

    questions: query_id, vector, QUESTION. A question meets its tenant's shards; shards and blocks of their questions make up units of work of a bounded size.
    The counts are the same in all rows of a question and shard; a shard where nothing is near gives one row without a claim.
    """
    width = questions.agg(F.max(F.size("vector")).alias("w")).first()["w"] or 0
    # named anew, as both sides of the cogroup come from the index
    shards = settle(index.select(F.col("tenant_id"), F.col("shard").alias("_shard")).distinct())
    asked = questions.select("query_id", F.col("vector").cast("array<double>").alias("asked"), *question_columns())
    per_tenant = settle(asked.groupBy("tenant_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")))
    asked = asked.join(per_tenant, "tenant_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int")).drop("_blocks").join(shards, "tenant_id").withColumnRenamed("_shard", "shard")
    held = index.join(per_tenant, "tenant_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    unit = ["tenant_id", "shard", "block"]
    return held.groupBy(*unit).cogroup(asked.groupBy(*unit)).applyInArrow(_unit(width, k, kept, least), HITS)


def _unit(width: int, k: int, kept: int, least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(graph: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if graph.num_rows and asked.num_rows:
            graph = graph.sort_by("node")
            unit, links = _matrix(graph.column("vector"), width), [np.array(x, np.int64) for x in graph.column("links").to_pylist()]
            codes = np.frombuffer(b"".join(graph.column("code").to_pylist()), np.int8).reshape(len(unit), -1).astype(np.float32) * graph.column("scale").to_numpy()[:, None].astype(np.float32)
            ids, q = graph.column("claim_id").to_numpy(), _matrix(asked.column("asked"), width)
            norm = np.linalg.norm(q, axis=1, keepdims=True)
            q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
            fits = open_to(graph, list(zip(*(asked.column(c).to_pylist() for c in QUESTION), strict=True)))
            for n, query_id in enumerate(asked.column("query_id").to_pylist()):
                found, read = walk(codes, links, fits[n], q[n].astype(np.float32), k, max(kept, k))
                near = np.round(unit[found] @ q[n], 6)
                best = [i for i in np.lexsort((ids[found], -near))[:k] if near[i] >= least]
                rows += [(query_id, int(ids[found[i]]), float(near[i]) + 0.0, read, len(found)) for i in best] or [(query_id, None, None, read, len(found))]
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["query_id", "claim_id", "score", "codes_read", "vectors_read"])

    return run


def graph_top_k(index: DataFrame, questions: DataFrame, k: int, kept: int = KEPT, least: float = -2.0) -> DataFrame:
    """query_id, claim_id, score, rank: the k best of all shards; ties go by id."""
    return top_k(search(index, questions, k, kept, least).where("claim_id IS NOT NULL").drop("codes_read", "vectors_read"), ["query_id"], k)
