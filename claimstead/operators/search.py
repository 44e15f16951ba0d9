"""Lexical and vector search for batches of queries."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimstead.functions.text import lexical_tokens
from claimstead.operators.fusion import top_k
from claimstead.operators.identity import settle
from claimstead.operators.perspective import QUESTION, claim_columns, open_to, question_columns


#: Vectors whose products with a block of queries are held at once.
SLICE = 512


def postings(texts: DataFrame) -> DataFrame:
    """claim_id, token, tf: the inverted index, with every run of a-z and 0-9."""
    runs = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return texts.select("claim_id", F.explode(runs).alias("token")).groupBy("claim_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def _by_blocks(queries: DataFrame, block: int, k: int, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The k best of each query, queries taken in blocks of about `block`, told by a hash; after every sixteen blocks what was found is written, so that plans stay short."""
    blocks = max(1, -(-queries.count() // block))
    local = None
    for b in range(blocks):
        part = found(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
        local = part if local is None else local.union(part)
        if b % 16 == 15:
            local = settle(local)
    return top_k(local, ["query_id"], k)


def _scoped(queries: DataFrame, claims: DataFrame) -> tuple[list[Column], list[Column]]:
    """Columns that tell what a query may see, of queries and claims, where both have them; else none, and every query sees all."""
    if set(QUESTION) <= set(queries.columns):
        return question_columns(), claim_columns()
    return [], []


def lexical_top_k(queries: DataFrame, texts: DataFrame, k: int, block: int = 256) -> DataFrame:
    """query_id, claim_id, score, rank: how many query tokens are substrings of the text, the k best.

    Queries are taken in blocks of about `block`. The tokens of a block are broadcast as one automaton, which finds all of
    them in one walk over a text, and each task gives its own k best of every query, so only those are shuffled. A query without a
    token gets the first k texts by id, with score 0; other texts must have a token. Null texts have none. Where queries have a perspective (perspective.asked) and
    texts its columns, only texts in it count, before the limit; texts are then taken to be not retracted.
    """
    return _by_blocks(queries, block, k, lambda part: _lexical_block(part, texts, k))


def _lexical_block(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    where, of = _scoped(queries, texts)
    asked = [(r["query_id"], r["terms"] or [], tuple(r)[2:]) for r in queries.select("query_id", lexical_tokens(F.col("text")).alias("terms"), *where).collect()]  # a block
    held = queries.sparkSession.sparkContext.broadcast(asked)
    types = {f.name: f.dataType for f in (queries.schema["query_id"], texts.schema["claim_id"])}
    arrow, scoped = [to_arrow_type(types[c]) for c in ("query_id", "claim_id")], bool(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        terms = sorted({t for _, own, _ in held.value for t in own})
        place = {t: i for i, t in enumerate(terms)}
        weight = np.zeros((len(terms), len(held.value)), np.float32)
        automaton = ahocorasick.Automaton()
        for t, i in place.items():
            automaton.add_word(t, i)
        if terms:
            automaton.make_automaton()
        for j, (_, own, _) in enumerate(held.value):
            for t in own:
                weight[place[t], j] += 1
        blank = np.array([not own for _, own, _ in held.value], bool)
        best: list[list[tuple]] = [[] for _ in held.value]
        for batch in batches:
            ids, scores = batch.column("claim_id").to_pylist(), np.zeros((batch.num_rows, len(held.value)), np.float32)
            fits = open_to(batch, [q for *_, q in held.value]).T if scoped else None
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text and terms and (fits is None or fits[i].any()):
                    scores[i] = weight[list({at for _, at in automaton.iter(text)})].sum(axis=0)
            scores[~((scores > 0) | blank) | (False if fits is None else ~fits)] = -1
            order = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
            for j in range(len(best)):
                top = order[np.argsort(-scores[order, j], kind="stable")[:k]]
                best[j] = heapq.nsmallest(k, best[j] + [(-float(scores[i, j]), ids[i]) for i in top if scores[i, j] >= 0])
        rows = [(q, c, int(-s)) for (q, *_), own in zip(held.value, best, strict=True) for s, c in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow[0]), pa.array([r[1] for r in rows], arrow[1]), pa.array([r[2] for r in rows], pa.int64())], ["query_id", "claim_id", "score"])

    shape = f"query_id {types['query_id'].simpleString()}, claim_id {types['claim_id'].simpleString()}, score long"
    return texts.select("claim_id", F.lower("text").alias("text"), *of).mapInArrow(run, shape)


def full_text_and(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Texts that have all terms of a query, ranked by the sum of term frequencies.

    A query's candidates are the texts with its rarest term; the others are looked up by (text, term). A query with a term that no text has finds none.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("token"))
    index = postings(texts).join(terms.select("token").distinct(), "token", "left_semi")
    index = settle(index)
    often = index.groupBy("token").agg(F.count(F.lit(1)).alias("texts"))
    rarest = terms.join(often, "token", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "token")).alias("r"), F.count(F.lit(1)).alias("need"))
    could = rarest.where("r.texts > 0").select("query_id", "need", F.col("r.token").alias("token")).join(index.select("token", "claim_id"), "token").select("query_id", "need", "claim_id")
    found = could.join(terms, "query_id").join(index, ["claim_id", "token"]).groupBy("query_id", "claim_id", "need").agg(F.count(F.lit(1)).alias("have"), F.sum("tf").alias("score"))
    return top_k(found.where("have = need"), ["query_id"], k).select("query_id", "claim_id", "score", "rank")


def full_text_or(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Texts that have any term of a query, unranked: the first k by id, filtered before the limit.

    One of a query's first k texts is among the first k of the term it has, so longer lists are cut before they meet the queries.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("token"))
    index = postings(texts).select("claim_id", "token").join(terms.select("token").distinct(), "token", "left_semi")
    heads = index.withColumn("_n", F.row_number().over(Window.partitionBy("token").orderBy("claim_id"))).where(F.col("_n") <= k)
    found = terms.join(heads, "token").select("query_id", "claim_id").distinct()
    order = Window.partitionBy("query_id").orderBy("claim_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_fault(vector: Column, width: int) -> Column:
    """What a vector is rejected for, or null: VECTOR_MISSING, VECTOR_WIDTH or VECTOR_NOT_FINITE."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull(), "VECTOR_MISSING").when(F.size(vector) != width, "VECTOR_WIDTH").when(odd, "VECTOR_NOT_FINITE")


def checked_vectors(vectors: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Vectors that have the width and only finite numbers, and the others with their fault."""
    told = vectors.withColumn("fault", vector_fault(F.col("vector"), width))
    return told.where("fault IS NULL").drop("fault"), told.where("fault IS NOT NULL")


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float = -2.0, block: int = 4096) -> DataFrame:
    """query_id, claim_id, score, rank by cosine to six digits, exactly. queries and vectors: an id and an array.

    Queries are taken in blocks of about `block`; the matrix of a block is broadcast, and each task gives its
    own k best of every query, so only those are shuffled. It holds the products of `SLICE` vectors at once. A zero vector has cosine 0. All queries must have one width and finite
    numbers, else a ValueError is raised; vectors that haven't are no candidates (checked_vectors names them). Where queries have a perspective and vectors its
    columns, only vectors in it count, before the limit.
    """
    width = _width(queries)
    return _by_blocks(queries, block, k, lambda part: _block_top_k(part, vectors, k, least, width))


def _width(queries: DataFrame) -> int:
    width = queries.agg(F.max(F.size("vector")).alias("w")).first()["w"] or 0
    faults = checked_vectors(queries, width)[1].groupBy("fault").count().collect()
    if faults:
        raise ValueError(f"query vectors are rejected: {sorted((r['fault'], r['count']) for r in faults)}")
    return width


def _block_top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float, width: int) -> DataFrame:
    where, of = _scoped(queries, vectors)
    rows = queries.select("query_id", "vector", *where).collect()  # a block
    ids, asked = [r["query_id"] for r in rows], [tuple(r)[2:] for r in rows]
    held, scoped = queries.sparkSession.sparkContext.broadcast((_unit([r["vector"] for r in rows], width), asked)), bool(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, asked_ = held.value
        best = Nearest(len(q), k, least)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            good, found = _good(batch.column("vector").to_pylist(), q.shape[1])
            own = batch.column("claim_id").to_numpy(zero_copy_only=False)[good]
            scores = np.round(q @ found.T, 6) if len(q) else np.zeros((0, len(own)))
            if scoped:
                scores[~open_to(batch, asked_)[:, good]] = -9.0
            best.add(own, scores)
        yield from best.rows(ids)

    return vectors.select("claim_id", "vector", *of).mapInArrow(run, "query_id long, claim_id long, score double")


class Nearest:
    """The k best vectors of each of n queries so far, of those that score `least` or more; ties go by id."""

    def __init__(self, n: int, k: int, least: float) -> None:
        self.k, self.least = k, least
        self.scores, self.ids = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, own: np.ndarray, scores: np.ndarray) -> None:
        """A column of scores for each vector of own. Only what reaches a query's k-th score so far is sorted."""
        bound = np.maximum(self.scores[:, -1:], self.least)
        if self.k == 0 or scores.shape[1] == 0:
            return
        for i in np.flatnonzero((scores >= bound).any(axis=1)).tolist():
            at = np.flatnonzero(scores[i] >= bound[i])
            line, ids = np.r_[self.scores[i], scores[i, at]], np.r_[self.ids[i], own[at]]
            top = np.lexsort((ids, -line))[: self.k]
            self.scores[i], self.ids[i] = line[top], ids[top]

    def rows(self, ids: list) -> Iterator[pa.RecordBatch]:
        n, place = np.nonzero(self.scores > -np.inf)
        columns = [pa.array(np.array(ids, np.int64)[n]), pa.array(self.ids[n, place]), pa.array(self.scores[n, place] + 0.0)]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "claim_id", "score"])


def _good(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of those that vector_fault rejects for nothing."""
    fit = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == width], np.int64)
    m = np.array([vectors[i] for i in fit], float).reshape(len(fit), width)
    finite = np.isfinite(m).all(axis=1)
    return fit[finite], _unit(m[finite], width)


def _unit(vectors: list | np.ndarray, width: int) -> np.ndarray:
    m = np.array(vectors, float).reshape(len(vectors), width)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
