"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fold, sliced, small, texts

#: Runs of letters, and of numbers that aren't digits.
LETTERS = re.compile(r"[^\W\d_]+")

#: Training documents of a language in expectation, rounds of expectation-maximisation, longest piece (that of the vocabulary), longest word scored at once.
DOCS_PER_LANGUAGE, ROUNDS, LONGEST, WORD = 4_000, 3, 16, 32

#: Probability of a letter that no piece has, and the count added to every piece.
UNKNOWN, PRIOR = 1e-7, 0.05

#: Words that a worker's cache holds at most.
CACHE = 300_000

_BASE, _SPREAD = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def letters_of(run: str) -> list[str]:
    """The letters of a run that may hold numbers such as one half or the Roman eight, which are no digits."""
    return "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; one of over WORD letters is cut."""
    found = LETTERS.findall(text.lower())
    if not text.isascii() and not all(map(str.isalpha, found)):
        found = [x for w in found for x in ([w] if w.isalpha() else letters_of(w))]
    return [w[i : i + WORD] for w in found for i in range(0, len(w), WORD)] if len(text) > WORD and any(len(w) > WORD for w in found) else found


def public_pieces(model_path: str) -> list[str]:
    """Pieces of a sentencepiece model that are letters, perhaps after a word-start mark, lower-cased."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = {p.lower() for p in (model.id_to_piece(i) for i in range(model.get_piece_size()))}
    return sorted(p for p in found if len(p) <= LONGEST and p != "▁" and p.removeprefix("▁").isalpha())


class Segmenter:
    """Finds pieces in many words at once: a word's substrings are hashed in numpy and looked up in two tables."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces)
        self.bits = 20
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        self.key = [np.zeros(1 << self.bits, np.uint64) for _ in range(2)]
        self.value = [np.zeros(1 << self.bits, np.int32) for _ in range(2)]
        for i, (key, slot, other) in enumerate(zip(keys.tolist(), *(self._slots(keys, t).tolist() for t in range(2)), strict=True), 1):
            t, at = (0, slot) if not self.key[0][slot] else (1, other)
            if self.key[t][at]:
                raise ValueError("pieces collide in both tables")
            self.key[t][at], self.value[t][at] = key, i

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def _slots(self, keys: np.ndarray, table: int) -> np.ndarray:
        return (keys * _SPREAD >> np.uint64(64 - self.bits - 8 * table)) & np.uint64((1 << self.bits) - 1)

    def pieces(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length: per start and length of a substring, the piece's number, 0 for none, size + 1 for an unknown letter."""
        n, width = len(words), len(words[0]) + 1
        codes = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width).astype(np.uint64) + np.uint64(1)
        out, h = [], np.zeros((n, width), np.uint64)
        for m in range(1, min(LONGEST, width) + 1):
            h = h[:, : width - m + 1] * _BASE + codes[:, m - 1 :]
            found = np.zeros(h.shape, np.int32)
            for t in range(2):
                slot = self._slots(h, t)
                found = np.where((found == 0) & (self.key[t][slot] == h), self.value[t][slot], found)
            if m == 1:
                found[:, 1:][found[:, 1:] == 0] = self.size + 1
                found[:, 0] = self.size + 2  # the word-start mark alone
            out.append(found)
        return out


def forward(found: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Words x positions x languages: probability of a word's first letters, summed over all segmentations."""
    n, width = found[0].shape
    f = np.zeros((width + 1, n, table.shape[1]))
    f[0] = 1.0
    for j in range(1, width + 1):
        for m in range(1, min(len(found), j) + 1):
            f[j] += f[j - m] * table[found[m - 1][:, j - m]]
    return f


def backward(found: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    n, width = found[0].shape
    b = np.zeros((width + 1, n, table.shape[1]))
    b[width] = 1.0
    for i in range(width - 1, -1, -1):
        for m in range(1, min(len(found), width - i) + 1):
            b[i] += b[i + m] * table[found[m - 1][:, i]]
    return b


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def full_table(p: np.ndarray) -> np.ndarray:
    """Rows for no piece, the pieces, an unknown letter and the bare word-start mark."""
    langs = p.shape[1]
    return np.vstack([np.zeros((1, langs)), p, np.full((1, langs), UNKNOWN), np.full((1, langs), 1e-2)])


def _tally(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows = [(langs.index(g), w, n) for g, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    return run


def _expect(held, pieces: list[str]):
    """Expected piece counts of (lang, word, n) rows under the current probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, segmenter = held.value, Segmenter(pieces)
        total = np.zeros(table.shape)
        for batch in batches:
            lang = batch.column("lang").to_numpy()
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
            for at in by_length(words).values():
                for k in range(0, len(at), 4096):
                    some = np.array(at[k : k + 4096])
                    found = segmenter.pieces([words[i] for i in some])
                    for g in np.unique(lang[some]):
                        own = lang[some] == g
                        part, column = [x[own] for x in found], table[:, g : g + 1]
                        f, b = forward(part, column)[..., 0], backward(part, column)[..., 0]
                        weight = n[some][own] / f[-1]
                        for m, ids in enumerate(part, 1):
                            for i in range(ids.shape[1]):
                                got = f[i] * column[ids[:, i], 0] * b[i + m] * weight
                                total[:, g] += np.bincount(ids[:, i], got, len(total))
        piece, lang = np.nonzero(total[1:-2])
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[1:-2][piece, lang])], ["lang", "piece", "n"])

    return run


def train(docs: DataFrame, pieces: list[str], docs_per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and per-language piece probabilities from documents with a language.

    The fit takes about docs_per_language documents of each language, drawn by a hash; their distinct words with counts are summed in
    Spark, and each round sums expected piece counts over them in Spark too. The driver gets a number per piece and language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    shares = docs.sparkSession.createDataFrame([(g, min(1.0, docs_per_language / n)) for g, n in sizes.items()], "_lang string, _share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < F.col("_share")
    drawn = known.join(small(shares, len(langs)), F.col("lang") == F.col("_lang")).where(draw).select("lang", "text")
    counts = cut(drawn.mapInArrow(_tally(langs), "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(full_table(p))
        got = counts.mapInArrow(_expect(held, pieces), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        p = np.full((len(pieces), len(langs)), PRIOR)
        p[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        p /= p.sum(axis=0)
    return langs, p


class Scorer:
    """Log-probabilities per language of words, kept in a bounded cache."""

    def __init__(self, pieces: list[str], p: np.ndarray) -> None:
        self.segmenter, self.table = Segmenter(pieces), full_table(p)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((CACHE, p.shape[1]))

    def words(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the score table, and the row of every word in turn."""
        met = {w for words in found for w in words}
        fresh = [w for w in met if w not in self.cache]
        if len(self.cache) + len(fresh) > len(self.rows):
            self.cache, fresh = {}, list(met)
            if len(fresh) > len(self.rows):
                self.rows = np.zeros((len(fresh), self.rows.shape[1]))
        for at in by_length(fresh).values():
            for k in range(0, len(at), 4096):
                some = [fresh[i] for i in at[k : k + 4096]]
                start = len(self.cache)
                self.rows[start : start + len(some)] = np.log(forward(self.segmenter.pieces(some), self.table)[-1])
                self.cache.update(zip(some, range(start, start + len(some)), strict=True))
        known = self.cache.__getitem__
        return self.rows, np.fromiter((known(w) for words in found for w in words), np.int64)


def _score(held, langs: list[str], pieces: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pieces, held.value)
        for batch in sliced(batches):
            found = [words_of(t) for t in texts(batch)]
            rows, at = scorer.words(found)
            ends = np.cumsum([len(w) for w in found])
            pred, score = ["und"] * len(found), np.zeros(len(found))
            start = 0
            for i, end in enumerate(ends.tolist()):
                if end > start and langs:
                    total = rows[at[start:end]].sum(axis=0)
                    odds = np.exp(total - total.max())
                    pred[i], score[i] = langs[int(odds.argmax())], odds.max() / odds.sum()
                start = end
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the language, equal priors) for every row of docs; whole texts, one pass, no shuffle.

    A null text or one without a letter gives und and 0, and so does every text if no language was learned. Equal posteriors go to
    the first language by name. Repeated rows are judged alike; extra columns are not read; an empty table gives an empty result.
    Very long texts are read whole; a run of over WORD (32) letters is scored in parts of 32, so its segmentations don't cross those cuts.
    """
    held = docs.sparkSession.sparkContext.broadcast(p)
    return docs.select("doc_id", "text").mapInArrow(_score(held, langs, pieces), "doc_id long, lang_pred string, score double")


def op4_segmentation_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    pieces = public_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    held_out = fold("doc_id", 4) == 2
    langs, p = train(docs.where(~held_out).select("doc_id", "text", "lang"), pieces)
    return identify(docs, pieces, langs, p).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
