"""Toxicity: a linear-chain conditional random field over words, with document scores from its marginals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fold, labels, sliced, small, texts

#: Training documents of each label in expectation, shards that fit side by side, passes of a shard over its documents.
TOXIC_DOCS, CLEAN_DOCS, SHARDS, PASSES = 5_000, 5_000, 8, 60

#: Weights of the hashed features, and words of one chain at most: a chain is a line, cut where it is longer.
WEIGHTS, CHAIN = 1 << 18, 128

#: Evidence that makes a word of a toxic document a labelled token: log odds ratio of document counts, and the same over its deviation.
LOG_ODDS, DEVIATIONS = 2.0, 3.0

#: Words that a worker's cache holds at most.
CACHE = 300_000

STRIP = ".,;:!?\"'()[]%&$*#|<>"


def core(word: str) -> str:
    return word.strip(STRIP).lower()


def traits(word: str) -> list[int]:
    """Hashed emission features of a word: its core, the core's first and last bytes, and its shape. The core comes first."""
    w = core(word)
    b = w.encode("utf-8", "surrogatepass")
    n = len(b)
    shape = 4 * word.isupper() + 2 * word[:1].isupper() + w.isalpha()
    return [
        crc32(b) % WEIGHTS, *[crc32(b[:k], k) % WEIGHTS for k in (4, 5, 6, 7, 8) if n > k],
        *[crc32(b[-k:], 100 + k) % WEIGHTS for k in (3, 4) if n > k], crc32(b"shape", shape) % WEIGHTS,
    ]


def lexical(word: str) -> list[str]:
    """What a word is counted by when labels of tokens are derived."""
    w = core(word)
    return [f"={w}", *(f"^{w[:k]}" for k in (5, 6, 7) if len(w) > k)] if w else []


class Chains:
    """The chains of many texts in flat arrays, ordered so that a step takes the same place of all chains that are long enough."""

    def __init__(self, documents_: list[list[list[str]]]) -> None:
        lines = [(d, line[i : i + CHAIN]) for d, doc in enumerate(documents_) for line in doc for i in range(0, len(line), CHAIN)]
        self.doc = np.array([d for d, _ in lines], np.int64)
        self.length = np.array([len(x) for _, x in lines], np.int64)
        self.words = list(chain.from_iterable(x for _, x in lines))
        start = np.cumsum(self.length) - self.length
        order = np.argsort(-self.length, kind="stable")
        self.start = start[order]
        self.alive = np.searchsorted(-self.length[order], -np.arange(1, (self.length.max() if len(lines) else 0) + 1), side="right")
        self.word_doc = np.repeat(self.doc, self.length)
        self.first = np.zeros(len(self.words), bool)
        self.first[start] = True
        self.last = np.roll(self.first, -1) if len(self.words) else self.first


def marginals(c: Chains, s: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for two states. s: scores of state toxic against clean; b: start, clean-toxic, toxic-clean, toxic-toxic.

    Gives P(toxic) per word, and the forward and backward ratios of toxic over clean; ratios are clipped, so nothing overflows.
    """
    e, (start, ct, tc, tt) = np.exp(np.clip(s, -30, 30)), np.exp(np.clip(b, -30, 30))
    r, q = np.empty(len(s)), np.ones(len(s))
    if len(s):
        r[c.start] = e[c.start] * start
    for t in range(1, len(c.alive)):
        at = c.start[: c.alive[t]] + t
        before = r[at - 1]
        r[at] = e[at] * np.clip((ct + before * tt) / (1 + before * tc), 1e-30, 1e30)
    for t in range(len(c.alive) - 2, -1, -1):
        at = c.start[: c.alive[t + 1]] + t
        after = e[at + 1] * q[at + 1]
        q[at] = np.clip((tc + tt * after) / (1 + ct * after), 1e-30, 1e30)
    rq = r * q
    return rq / (1 + rq), r, q


@dataclass
class Field:
    """Weights of hashed features for a word, the word before and the word after, and the chain's own."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    chain: np.ndarray
    document: np.ndarray

    @staticmethod
    def new() -> Field:
        return Field(np.zeros(WEIGHTS), np.zeros(WEIGHTS), np.zeros(WEIGHTS), np.array([-3.0, -3.0, 0.0, 0.0]), np.array([-2.0, 4.0, 0.0]))


def vocabulary(words: list[str]) -> tuple[np.ndarray, list[str]]:
    codes, names = pd.factorize(np.array(words, object))
    return codes, names.tolist()


def shifted(values: np.ndarray, c: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Values of the word before and after, 0 at a chain's ends."""
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    before[c.first], after[c.last] = 0, 0
    return before, after


def chain_gradient(c: Chains, s: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the labels' log-likelihood by the words' scores s and by the chain's weights b: observed less expected."""
    p, r, q = marginals(c, s, b)
    g = y - p
    prev = np.flatnonzero(~c.first) - 1
    e, (ct, tc, tt) = np.exp(np.clip(s, -30, 30))[prev + 1] * q[prev + 1], np.exp(np.clip(b[1:], -30, 30))
    joint = np.stack([ct * e, r[prev] * tc, r[prev] * tt * e])
    joint /= 1 + joint.sum(axis=0)
    a, z = y[prev], y[prev + 1]
    return g, np.array([g[c.first].sum(), ((1 - a) * z).sum() - joint[0].sum(), (a * (1 - z)).sum() - joint[1].sum(), (a * z).sum() - joint[2].sum()])


def fit(c: Chains, truth: np.ndarray, passes: int = PASSES) -> Field:
    """Maximum likelihood by AdaGrad on whole passes, from the exact gradient: observed less expected features."""
    field, codes_names = Field.new(), vocabulary(c.words)
    codes, names = codes_names
    features = [traits(w) for w in names]
    width = max(map(len, features), default=1)
    table = np.full((len(names), width), WEIGHTS, np.int64)
    for i, f in enumerate(features):
        table[i, : len(f)] = f
    identity = table[:, 0]
    own, chain_, grad2 = np.zeros(WEIGHTS + 1), field.chain.copy(), np.full(WEIGHTS + 1, 1e-2)
    sides, side2 = np.zeros((2, WEIGHTS + 1)), np.full((2, WEIGHTS + 1), 1e-2)
    chain2 = np.full(4, 1.0)
    y = truth.astype(float)
    n = max(1, len(c.words))
    for _ in range(passes):
        word = own[table].sum(axis=1)
        left, right = sides[0][identity][codes], sides[1][identity][codes]
        s = word[codes] + shifted(left, c)[0] + shifted(right, c)[1]
        g, by_chain = chain_gradient(c, s, chain_, y)
        by_word = np.bincount(codes, g, len(names))
        grad = np.bincount(table.ravel(), np.repeat(by_word, width), WEIGHTS + 1) - 1e-3 * own
        grad[WEIGHTS] = 0
        grad2 += grad**2
        own += 0.3 * grad / np.sqrt(grad2)
        after, before = shifted(g, c)[1], shifted(g, c)[0]
        for k, moved in enumerate((after, before)):  # a word's weight as the one before acts on the next, and the other way round
            grad = np.bincount(identity, np.bincount(codes, moved, len(names)), WEIGHTS + 1) - 1e-2 * sides[k]
            side2[k] += grad**2
            sides[k] += 0.1 * grad / np.sqrt(side2[k])
        seen = by_chain - 1e-3 * n / 100 * chain_
        chain2 += seen**2
        chain_ += 0.3 * seen / np.sqrt(chain2)
    field.own, field.before, field.after, field.chain = own[:-1], sides[0][:-1], sides[1][:-1], chain_
    return field


class Tagger:
    """Marginals of whole texts; a word's feature sums are kept in a bounded cache."""

    def __init__(self, field: Field) -> None:
        self.field, self.cache = field, {}
        self.rows = np.zeros((CACHE, 3))

    def _codes(self, words: list[str]) -> np.ndarray:
        met = set(words)
        fresh = [w for w in met if w not in self.cache]
        if len(self.cache) + len(fresh) > len(self.rows):
            self.cache, fresh = {}, list(met)
            if len(fresh) > len(self.rows):
                self.rows = np.zeros((len(fresh), 3))
        if fresh:
            start, f = len(self.cache), self.field
            features = [traits(w) for w in fresh]
            sizes = np.fromiter(map(len, features), np.int64, len(fresh))
            first, flat = np.cumsum(sizes) - sizes, np.fromiter(chain.from_iterable(features), np.int64, int(sizes.sum()))
            self.rows[start : start + len(fresh)] = np.stack([np.add.reduceat(f.own[flat], first), f.before[flat[first]], f.after[flat[first]]], 1)
            self.cache.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def tag(self, found: list[str]) -> tuple[Chains, np.ndarray]:
        c = Chains([[line.split() for line in t.split("\n")] for t in found])
        if not c.words:
            return c, np.zeros(0)
        rows = self.rows[self._codes(c.words)] if c.words else np.zeros((0, 3))
        s = rows[:, 0] + shifted(rows[:, 1], c)[0] + shifted(rows[:, 2], c)[1]
        return c, marginals(c, s, self.field.chain)[0]


def summaries(c: Chains, p: np.ndarray, n: int) -> np.ndarray:
    """Per document: one, its largest marginal, and the log of one plus its expected number of toxic words among marginals over a tenth."""
    top, mass = np.zeros(n), np.bincount(c.word_doc, np.where(p > 0.1, p, 0.0), n) if len(p) else np.zeros(n)
    if len(p):
        np.maximum.at(top, c.word_doc, p)
    return np.stack([np.ones(n), top, np.log1p(mass)], 1)


def spans(text: str, p: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Start and end (code points) of runs of words whose marginals reach the threshold; p has the text's words in order."""
    found, at, i = [], 0, 0
    for line in text.split("\n"):
        end = at
        joined = False
        for word in line.split():
            start = text.index(word, end)
            end = start + len(word)
            if p[i] >= threshold:
                if joined:
                    found[-1] = (found[-1][0], end)
                else:
                    found.append((start, end))
            joined = bool(p[i] >= threshold)
            i += 1
        at += len(line) + 1
        end = at
    return found


def _lexicon_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for y, text in zip(batch.column("y").to_pylist(), texts(batch), strict=True):
            seen[y].update({f for w in set(text.split()) for f in lexical(w)})
        rows = [(f, y, n) for y, c in seen.items() for f, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["trait", "y", "n"])


def _fit_shard(held):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending")])
        lexicon = held.value
        found = [[line.split() for line in (t or "").split("\n")] for t in rows.column("text").to_pylist()]
        c = Chains(found)
        toxic = np.array(rows.column("y").to_pylist(), bool)
        codes, names = vocabulary(c.words)
        listed = np.array([any(f in lexicon for f in lexical(w)) for w in names], bool)
        truth = listed[codes] & toxic[c.word_doc] if c.words else np.zeros(0, bool)
        f = fit(c, truth)
        used = np.flatnonzero((f.own != 0) | (f.before != 0) | (f.after != 0))
        return pa.table({
            "at": pa.array(np.r_[used, WEIGHTS + np.arange(4)]), "own": pa.array(np.r_[f.own[used], f.chain]),
            "before": pa.array(np.r_[f.before[used], np.zeros(4)]), "after": pa.array(np.r_[f.after[used], np.zeros(4)]),
        })

    return run


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method on a few columns."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return w


def train(docs: DataFrame, truth: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, shards: int = SHARDS) -> Field:
    """A field learned from documents and truth (doc_id, toxic), on about toxic_docs and clean_docs documents drawn by a hash.

    Token labels: words, or word beginnings, that toxic documents have far oftener than clean ones (LOG_ODDS, DEVIATIONS) are toxic
    tokens in toxic documents; all other tokens are clean. Shards of the drawn documents are fitted side by side in Spark and
    their weights averaged. Last, a logistic regression maps a document's marginals to its label. With no label, or one alone,
    the field is untrained and every score is low. Several labels of a doc_id count as their maximum.
    """
    spark = docs.sparkSession
    known = truth.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Field.new()
    share = F.when(F.col("y") == 1, min(1.0, toxic_docs / sizes[1])).otherwise(min(1.0, clean_docs / sizes[0]))
    drawn = cut(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < share))
    rows = docs.join(small(drawn.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    rows = cut(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards))))
    n1, n0 = rows.where("y = 1").count(), rows.where("y = 0").count()
    if not n0 or not n1:
        return Field.new()

    counts = rows.select("y", "text").mapInArrow(_lexicon_counts, "trait string, y int, n long")
    counts = counts.groupBy("trait").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    deviation = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    # at most as many as the bounded sample has words
    lexicon = {r["trait"] for r in counts.where((odds > LOG_ODDS) & (odds > DEVIATIONS * deviation)).select("trait").toLocalIterator()}

    held = spark.sparkContext.broadcast(lexicon)
    parts = rows.groupBy("shard").applyInArrow(_fit_shard(held), "at long, own double, before double, after double")
    # a feature that a shard never met has weight 0 there and isn't averaged in
    mean = parts.groupBy("at").agg(F.avg("own").alias("own"), F.avg("before").alias("before"), F.avg("after").alias("after")).toPandas()
    field = Field.new()
    at, tail = mean["at"].to_numpy(), mean["at"].to_numpy() >= WEIGHTS
    field.chain[at[tail] - WEIGHTS] = mean["own"].to_numpy()[tail]
    for name in ("own", "before", "after"):
        getattr(field, name)[at[~tail]] = mean[name].to_numpy()[~tail]
    seen = _score_rows(rows, field).toPandas()  # three numbers for each drawn document
    field.document = logistic(np.array(seen["summary"].tolist()), seen["y"].to_numpy(float))
    return field


def _score_rows(rows: DataFrame, field: Field) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value)
        for batch in sliced(batches):
            c, p = tagger.tag(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(summaries(c, p, batch.num_rows).tolist(), pa.list_(pa.float64()))], ["y", "summary"])

    return rows.select("text", "y").mapInArrow(run, "y int, summary array<double>")


def score(docs: DataFrame, field: Field, with_spans: bool = True) -> DataFrame:
    """doc_id, score, and the toxic spans (start, end in code points) of every row's whole text, in one pass without a shuffle.

    The score is the logistic of a document's largest marginal and of its expected number of toxic words. Null and empty texts have
    no words: their score is that of no evidence and they have no spans. Repeated rows are scored alike; an empty table gives an
    empty result; extra columns are not read. Very long texts are read whole; a line of over CHAIN (128) words is cut into chains of so many, each of which loses the transition into it.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value)
        for batch in sliced(batches):
            found = texts(batch)
            c, p = tagger.tag(found)
            s = 1 / (1 + np.exp(-np.clip(summaries(c, p, len(found)) @ held.value.document, -30, 30)))
            columns, names = [batch.column("doc_id"), pa.array(s)], ["doc_id", "score"]
            if with_spans:
                ends = np.searchsorted(c.word_doc, np.arange(len(found) + 1))
                got = [[{"start": x, "end": y} for x, y in spans(t, p[a:b])] if b > a and (p[a:b] >= 0.5).any() else [] for t, a, b in zip(found, ends[:-1], ends[1:], strict=True)]
                columns.append(pa.array(got, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double" + ", spans array<struct<start: int, end: int>>" * with_spans)


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 5) == 0
    field = train(docs.select("doc_id", "text"), labels(spark, sf_dir).where(~held_out).select("doc_id", "toxic"))
    return score(docs, field).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
