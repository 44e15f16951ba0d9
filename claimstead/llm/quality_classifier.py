"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fold, labels, sliced, texts

#: Random features, kernel width, ridge penalty per training row, calibration bins, seed.
FEATURES, GAMMA, RIDGE, BINS, SEED = 256, 0.18, 1e-4, 400, 7

NAMES = [
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "shouts", "bars", "high_bytes", "blanks", "lines",
    "distinct", "same_as_last", "dup_lines", "marked_words", "ends_in_stop", "line_words", "letters",
]

# Byte classes: 0 other letters and the rest, 1 upper, 2 digit, 3 stops and other marks, 4 symbols, 5 "!", 6 "|", 7 non-ASCII, 8 blank, 9 newline
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-/", b"#*$%&<>@^~={}[]\\+_`", b"!", b"|"), 1):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _i
_CLASS[128:] = 7
_CLASS[[32, 9, 11, 12, 13]] = 8
_CLASS[10] = 9


def statistics(text: str) -> list[float]:
    """Eighteen numbers of a whole text; an empty one has all zero."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(_CLASS[data], minlength=10).tolist()
    n, size = len(words), len(data)
    solid = size - count[8] - count[9]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    same = sum(map(eq, words, words[1:]))
    marked = count[4] + count[5] + count[6]
    return [
        np.log1p(n), solid / n, count[1] / solid, count[2] / solid, count[3] / solid, count[4] / solid, count[5] / n, count[6] / n,
        count[7] / solid, count[8] / size, count[9] / n, len(set(words)) / n, same / n, 1 - len(set(lines)) / len(lines),
        min(1.0, marked / n), sum(w[-1] in ".!?" for w in words[:1] + words[-1:]) / 2, np.log1p(n / len(lines)), count[0] / solid,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        values = pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "stats"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """A constant, then cosines whose inner products approximate a Gaussian kernel of the standardised statistics."""
        rng = np.random.default_rng(SEED)
        w, b = rng.normal(0, GAMMA, (len(NAMES), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(x @ w + b)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; documents on one isotonic level keep the order of their raw scores within a thousandth."""
        raw = self.raw(stats)
        level = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.full(len(raw), 0.5)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -50, 50))), 0, 1)


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else list(column), float).reshape(-1, len(NAMES))


def _normal(held):
    """Rows (i, v) of a partition's sum of outer products of (features, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = held.value, np.zeros((FEATURES + 2, FEATURES + 2))
        for batch in batches:
            z = np.hstack([model.features(matrix(batch.column("stats"))), batch.column("y").to_numpy()[:, None]])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    return run


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins with sums y and sizes n, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, b in zip(y.tolist(), n.tolist(), strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), a / b) for a, b, k in blocks]) if blocks else np.zeros(0)


def train(rows: DataFrame) -> Model:
    """Fit on rows (stats, y); all of them count. The driver gets sums of a fixed size only.

    Without rows, or with one label alone, every score is that label's share or a half.
    """
    sc = rows.sparkSession.sparkContext
    moments = rows.select(*[f(F.get("stats", F.lit(i))) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)], F.avg("y")).first()
    if moments[-1] is None:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    mean, scale = np.array(moments[:-1:2], float), np.maximum(np.array(moments[1:-1:2], float), 1e-6)
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    sums = rows.mapInArrow(_normal(sc.broadcast(model)), "i int, v array<double>")
    sums = sums.groupBy("i").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(FEATURES + 2)]).alias("v")).collect()
    total = np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])
    n = total[0, 0]
    model.weights = np.linalg.solve(total[:-1, :-1] + RIDGE * n * np.eye(FEATURES + 1), total[:-1, -1])

    held = sc.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((held.value.raw(matrix(batch.column("stats"))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["bin", "y"])

    bins = rows.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("y").alias("n")).orderBy("bin").toPandas()
    model.knots = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    model.levels = isotonic(bins["y"].to_numpy(float), bins["n"].to_numpy(float))
    return model


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats for every row, from one pass over the texts; null counts as empty. A few hundred bytes a document."""
    return docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, stats array<double>")


def learn(stats: DataFrame, truth: DataFrame, label: str = "quality") -> Model:
    """A model from rows of stats and the rows of truth (doc_id, label) with a label.

    Texts, of any length, were read whole; they aren't read again: labels meet statistics, not documents. Several labels of a doc_id count as their maximum; a null
    doc_id has no label.
    """
    known = truth.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    return train(cut(stats.join(known, "doc_id").select("stats", "y")))


def classify(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of stats. Repeated rows get one score; empty texts are scored like others; an empty table gives an empty result."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(matrix(batch.column("stats"))))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of docs with a score of `least` or more, in one pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            stats = np.array([statistics(t) for t in texts(batch)]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(held.value.score(stats) >= least))

    return docs.mapInArrow(run, docs.schema)


def op3_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(document_statistics(documents(spark, sf_dir)))
    held_out = fold("doc_id", 5) == 0
    scored = classify(stats, learn(stats, labels(spark, sf_dir).where(~held_out).select("doc_id", "quality")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
