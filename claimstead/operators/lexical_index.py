"""A kept inverted index: segments of some thousand texts with their runs of letters and digits, postings and the most a run occurs in a text. Written once, added to by batch."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimstead.functions.text import lexical_tokens
from claimstead.operators.fusion import top_k
from claimstead.operators.identity import settle, shared_folder, small
from claimstead.operators.perspective import CLAIM, QUESTION, claim_columns, open_to, question_columns

#: Counts up with every change of what a segment holds, so that a kept index of an older kind is not read.
FORMAT = 2

#: Texts of a segment, and questions that are taken at once, in expectation.
SEGMENT, BLOCK = 1024, 256

#: Distinct runs of a segment in which tokens are looked for at once, and the letters of tokens that are told by a table of all such.
MEMORY, SHORT = 100_000, 4


def segments(texts: DataFrame, batch: str = "0", per_segment: int = SEGMENT) -> DataFrame:
    """A row for each segment of texts (claim_id, text, and CLAIM where they have it): claim ids in order, their place and times, the distinct runs in order, and of each run the texts that have it, how often, and the most.

    Runs are one text, parted by blanks, and numbers are bytes (_packed): as arrays Spark reads and writes them one by one, which takes longer than the search. A segment lies in one tenant and namespace, so that a question's perspective leaves whole segments out. Null texts have no runs. batch tells segments of later
    additions apart.
    """
    scoped = set(CLAIM) <= set(texts.columns)
    where = ["tenant_id", "namespace_id"] if scoped else []
    held = texts.select("claim_id", "text", *(claim_columns() if scoped else []))
    sizes = settle(held.groupBy(*where).agg(F.count(F.lit(1)).alias("_n")) if scoped else held.agg(F.count(F.lit(1)).alias("_n")))
    beside = held.join(small(sizes), [held[c].eqNullSafe(sizes[c]) for c in where]).drop(*[sizes[c] for c in where]) if scoped else held.crossJoin(F.broadcast(sizes))
    dealt = beside.withColumn("_part", F.pmod(F.xxhash64("claim_id"), F.greatest(F.ceil(F.col("_n") / per_segment), F.lit(1)))).drop("_n")
    id_ = to_arrow_type(texts.schema["claim_id"].dataType)
    times = ["valid_from", "valid_to", "recorded_at"] if scoped else []

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("claim_id")
        runs, number, place_ = _runs(part.column("text").combine_chunks())
        posting, tf = np.unique(number * max(part.num_rows, 1) + place_, return_counts=True)
        number, place_ = np.divmod(posting, max(part.num_rows, 1))
        counts = np.bincount(number, minlength=len(runs))
        most = np.maximum.reduceat(tf, np.cumsum(counts) - counts) if len(runs) else tf
        joined = pa.array([" ".join(runs.to_pylist())], pa.string())
        columns = {
            "batch": pa.array([batch]), "part": part.column("_part").slice(0, 1), **{c: part.column(c).slice(0, 1) for c in where}, "claim_ids": pa.array([part.column("claim_id").to_pylist()], pa.list_(id_)),
            **{c: pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in times}, "runs": joined,
            **{c: pa.array([_packed(values)], pa.binary()) for c, values in (("counts", counts), ("places", place_), ("tf", tf), ("most", most))},
        }
        return pa.table(columns)

    place = ", ".join(f"{c} string" for c in where) + (", " if scoped else "")
    shape = f"batch string, part long, {place}claim_ids array<{texts.schema['claim_id'].dataType.simpleString()}>, " + "".join(f"{c} array<long>, " for c in times) + "runs string, counts binary, places binary, tf binary, most binary"
    return dealt.groupBy(*where, "_part").applyInArrow(pack, shape)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, each in as few bytes as the greatest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))).newbyteorder("<")).tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    """n numbers as _packed gives them."""
    return np.frombuffer(packed, f"<u{len(packed) // n}" if n else "<u1")


#: A byte of a text in lower case; 0 for those that part runs.
_LETTERS = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _LETTERS[_c] = _LETTERS[ord(chr(_c).upper())] = _c
#: The signs of runs and of what parts them in a segment, and the number of each.
_SIGNS = b" 0123456789abcdefghijklmnopqrstuvwxyz"
_CODES = np.zeros(256, np.int32)
_CODES[list(_SIGNS)] = np.arange(len(_SIGNS))
#: The other characters whose lower case has a letter of a-z.
_LOWER = {"\u212a": "k", "\u0130": "i\u0307"}


def _runs(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct runs of a-z and 0-9 of texts in lower case, in order; and of every run in the texts its number there and its text's place. Bytes are worked on all at once."""
    texts = pc.fill_null(texts, "")
    for sign, lower in _LOWER.items():
        texts = pc.replace_substring(texts, sign, lower)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    signs = _LETTERS[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends.astype(np.int64) - ends[0]
    inside = np.r_[False, signs > 0, False]
    cut = np.zeros(len(inside), bool)  # a text begins here
    cut[ends + 1] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[1:-1]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[2:]))
    offsets = np.r_[0, np.cumsum(last - first + 1)].astype(np.int32)
    every = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(signs[inside[1:-1]])).dictionary_encode()
    order = pc.sort_indices(every.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return every.dictionary.take(pa.array(order)), rank[every.indices.to_numpy()], np.searchsorted(ends, first, "right") - 1


def write(texts: DataFrame, folder: str, batch: str = "0", per_segment: int = SEGMENT) -> None:
    """Add the segments of a batch of texts to the index below folder; a batch that is written again replaces itself."""
    segments(texts, batch, per_segment).write.mode("overwrite").parquet(f"{folder}/batch-{hashlib.sha256(batch.encode()).hexdigest()[:16]}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/batch-*")


_folders: dict[str, str] = {}


def kept(texts: DataFrame, name: str) -> DataFrame:
    """The index of a frame that is read from files, kept in the shared folder under a name and a fingerprint of those files: it is built the first time, and again once a file has changed."""
    spark = texts.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def told(file: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(file)
        s = at.getFileSystem(conf).getFileStatus(at)
        return f"{file} {s.getLen()} {s.getModificationTime()}"

    mark = hashlib.sha256("\n".join([str(FORMAT), name, *texts.columns, *sorted(map(told, texts.inputFiles()))]).encode()).hexdigest()[:24]
    root = _folders.setdefault(spark.sparkContext.applicationId, shared_folder(spark)).rstrip("/")
    folder = f"{root}/lexical-{mark}"
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/_READY")):
        write(texts, folder)
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/_READY"), True).close()
    return read(spark, folder)


class Within:
    """Finds terms of a-z and 0-9 within a text of such runs: those of up to SHORT letters, which nearly all runs have some of, in tables of all such, a text at once; longer ones by an automaton."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.tables, self.longer = {n: np.full(len(_SIGNS) ** n, -1, np.int32) for n in {len(t) for t in terms} if n <= SHORT}, ahocorasick.Automaton()
        for i, t in enumerate(terms):
            if len(t) <= SHORT:
                self.tables[len(t)][[code for _, code in self._codes(t, len(t))][-1]] = i
            else:
                self.longer.add_word(t, i)
        self.longer.make_automaton()

    @staticmethod
    def _codes(text: str, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each length up to most the codes of all windows of it, as numbers to the base of the signs there are."""
        signs = _CODES[np.frombuffer(text.encode(), np.uint8)]
        codes = signs
        for n in range(1, most + 1):
            yield n, codes
            codes = codes[:-1] * len(_SIGNS) + signs[n:]

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of terms, and the place in the text of a letter of each; in no order, a term as often as it occurs."""
        terms, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, codes in self._codes(text, max(self.tables, default=0)):
            if n in self.tables:
                number = self.tables[n][codes]
                places.append(np.flatnonzero(number >= 0))
                terms.append(number[places[-1]].astype(np.int64))
        if len(self.longer):
            ends, numbers = np.fromiter(chain.from_iterable(self.longer.iter(text)), np.int64).reshape(-1, 2).T
            places.append(ends)
            terms.append(numbers)
        return np.concatenate(terms), np.concatenate(places)


class Segment:
    """A row of a batch of segments as arrays, of the columns that it has."""

    def __init__(self, batch: pa.RecordBatch, at: int) -> None:
        self.ids, self.text = batch.column("claim_ids")[at].values.to_pylist(), batch.column("runs")[at].as_py()
        signs = np.frombuffer(self.text.encode(), np.uint8)
        blanks = np.flatnonzero(signs == 32)
        #: Where each run begins in the text, and where the next one would.
        self.begins = np.r_[0, blanks + 1, len(signs) + 1] if len(signs) else np.zeros(1, np.int64)
        self.run_at = np.cumsum(signs == 32)
        n = len(self.begins) - 1
        offsets = (self.begins - np.arange(n + 1)).astype(np.int32)
        self.runs = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(signs[signs != 32]))
        packed = lambda c, n: _unpacked(batch.column(c)[at].as_py(), n) if c in batch.schema.names else None
        self.counts, self.most = packed("counts", n).astype(np.int64), packed("most", n)
        self.starts = np.r_[0, np.cumsum(self.counts)]
        self.places, self.tf = packed("places", self.starts[-1]), packed("tf", self.starts[-1])
        self.batch, self.at = batch, at

    def fits(self, questions: list[tuple]) -> np.ndarray:
        place = [pa.array([self.batch.column(c)[self.at].as_py()] * len(self.ids), pa.string()) for c in ("tenant_id", "namespace_id")]
        columns = [*place, *(self.batch.column(c)[self.at].values for c in ("valid_from", "valid_to", "recorded_at"))]
        return open_to(pa.RecordBatch.from_arrays(columns, CLAIM), questions)

    def known(self, terms: list[str]) -> np.ndarray:
        """The number of each term among the runs; -1 where the segment hasn't got it."""
        return pc.fill_null(pc.index_in(pa.array(terms, pa.string()), value_set=self.runs), -1).to_numpy().astype(np.int64)

    def holding(self, within: Within) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a term and a run that has it within, each once, in order: numbers of terms, and of runs."""
        n, pairs = len(self.runs), []
        for at in range(0, n, MEMORY):
            since, until = self.begins[at], self.begins[min(at + MEMORY, n)] - 1
            terms, places = within.found(self.text[since:until])
            pairs.append(terms * n + self.run_at[places + since])
        found = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return np.divmod(found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found, max(n, 1))

    def bits(self, runs: np.ndarray, until: int | None = None) -> np.ndarray:
        """A row of bits, a multiple of 64 of them, for each of some runs: the places, before until, of the texts that have it."""
        number, at = self.postings(runs)
        places = self.places[at]
        if until is not None:
            number, places = number[places < until], places[places < until]
        width = -(-len(self.ids) // 64) * 8
        out = np.zeros(len(runs) * width, np.uint8)
        np.bitwise_or.at(out, number * width + (places >> 3), (128 >> (places & 7)).astype(np.uint8))
        return out.reshape(len(runs), width)

    def postings(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some runs, one after another: the number of the run in the list, and the places in the postings."""
        sizes = self.counts[runs]
        return np.repeat(np.arange(len(runs)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[runs], sizes)


class Best:
    """The k best of each question so far; ties go by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.held = k, [[] for _ in range(n)]

    def least(self, j: int) -> float:
        """What a further text must reach."""
        return -self.held[j][-1][0] if len(self.held[j]) == self.k else -np.inf

    def add(self, j: int, ids: list, scores: np.ndarray, places: np.ndarray) -> None:
        """places are those of candidates, in the order of ids."""
        top = places[np.argsort(-scores[places], kind="stable")[: self.k]]
        self.held[j] = sorted(self.held[j] + [(-float(scores[i]), ids[i]) for i in top])[: self.k]


def _asked(index: DataFrame, queries: DataFrame, k: int, block: int, terms, score: Callable, reads: tuple[str, ...] = ("runs", "counts", "places")) -> DataFrame:
    """Blocks of questions are broadcast; every task goes through the columns of its segments that the score reads and gives its k best of each question, so only those are shuffled."""
    scoped = set(QUESTION) <= set(queries.columns) and "tenant_id" in index.columns
    index = index.select(*(CLAIM if scoped else []), "claim_ids", *reads)
    columns = question_columns() if scoped else []
    id_ = index.schema["claim_ids"].dataType.elementType
    types = {"query_id": queries.schema["query_id"].dataType, "claim_id": id_}
    shape = f"query_id {types['query_id'].simpleString()}, claim_id {id_.simpleString()}, score long"
    arrow = [to_arrow_type(t) for t in types.values()]
    blocks = max(1, -(-queries.count() // block))
    local = None
    for b in range(blocks):
        part = settle(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
        asked = [(r["query_id"], r["terms"] or [], tuple(r)[2:]) for r in part.select("query_id", terms.alias("terms"), *columns).collect()]  # a block
        held = queries.sparkSession.sparkContext.broadcast(asked)
        some = index
        if scoped:  # segments that no question of the block may see aren't read; a question without a namespace sees all of its tenant
            seen = F.broadcast(part.select(F.col("tenant_id").alias("_t"), F.col("namespace_id").alias("_n")).distinct())
            some = index.join(seen, (F.col("tenant_id") == F.col("_t")) & (F.col("_n").isNull() | (F.col("namespace_id") == F.col("_n"))), "left_semi")

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            questions = held.value
            best = Best(len(questions), k)
            work = score(questions)
            for segment in (Segment(batch, at) for batch in batches for at in range(batch.num_rows)):
                work(segment, segment.fits([q for *_, q in questions]) if scoped else None, best)
            rows = [(q, c, int(-s)) for (q, *_), own in zip(questions, best.held, strict=True) for s, c in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow[0]), pa.array([r[1] for r in rows], arrow[1]), pa.array([r[2] for r in rows], pa.int64())], ["query_id", "claim_id", "score"])

        found = some.mapInArrow(run, shape)
        local = found if local is None else local.union(found)
        if b % 16 == 15:
            local = settle(local)
    return top_k(local, ["query_id"], k)


def lexical_top_k(queries: DataFrame, index: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """search.lexical_top_k from the index: query_id, claim_id, score, rank.

    A question's tokens are looked for in a segment's distinct runs, all at once, not in its texts; the texts that have a token are bits. As many tokens as a segment has at all bound what its texts
    can score: where that is under a question's k-th score so far, its postings aren't touched for it.
    """

    def score(questions: list[tuple]) -> Callable:
        terms, own, starts, asking = _listed(questions)
        within = Within(terms)
        blank = [j for j, (_, own_, _) in enumerate(questions) if not own_]
        each = np.split(own, starts[1:])

        def work(segment: Segment, fits: np.ndarray | None, best: Best) -> None:
            n = len(segment.ids)
            everywhere = np.arange(n)
            for j in blank:
                best.add(j, segment.ids, np.zeros(n), everywhere if fits is None else np.flatnonzero(fits[j]))
            if not terms:
                return
            number, run = segment.holding(within)
            if not len(number):
                return
            at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            present = number[at]
            has = np.zeros(len(terms), np.int64)
            has[present] = 1
            bound = np.add.reduceat(has[own], starts)
            least = np.array([best.least(j) for j in asking])
            open_ = np.flatnonzero((bound > 0) & (bound >= least) & (True if fits is None else fits[asking].any(axis=1)))
            if not len(open_):
                return
            texts = segment.bits(np.arange(len(segment.runs))).view(np.uint64)
            where = np.zeros((len(terms), texts.shape[1]), np.uint64)
            for t, since, until in zip(present.tolist(), at.tolist(), [*at[1:].tolist(), len(run)], strict=True):
                np.bitwise_or.reduce(texts[run[since:until]], axis=0, out=where[t])
            has_it = np.unpackbits(where.view(np.uint8), axis=1)[:, :n]
            for i in open_.tolist():
                j, line = int(asking[i]), has_it[each[i]].sum(axis=0, dtype=np.int64)
                good = (line > 0) & (line >= least[i])
                best.add(j, segment.ids, line, np.flatnonzero(good if fits is None else good & fits[j]))

        return work

    return _asked(index, queries, k, block, lexical_tokens(F.col("text")), score)


def _listed(questions: list[tuple]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms in order; the numbers of all questions' terms one after another, where each question's begin, and which questions those are: the ones that have any."""
    terms = sorted({t for _, own, _ in questions for t in own})
    place = {t: i for i, t in enumerate(terms)}
    sizes = np.array([len(own) for _, own, _ in questions], np.int64)
    asking = np.flatnonzero(sizes)
    return terms, np.array([place[t] for _, own, _ in questions for t in own], np.int64), np.cumsum(sizes[asking]) - sizes[asking], asking


def full_text_and(queries: DataFrame, index: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """search.full_text_and from the index: texts that have all `terms` of a question, by the sum of term frequencies. A segment that lacks a term, or whose greatest frequencies add up to less than the k-th score so far, is left out."""

    def score(questions: list[tuple]) -> Callable:
        terms, own, starts, asking = _listed(questions)
        each = [np.unique(part) for part in np.split(own, starts[1:])]

        def work(segment: Segment, fits: np.ndarray | None, best: Best) -> None:
            known, n = segment.known(terms), len(segment.ids)
            for j, part in zip(asking.tolist(), each, strict=False):
                runs = known[part]
                if runs.min() < 0 or segment.most[runs].sum() < best.least(j):
                    continue
                _, at = segment.postings(runs)
                places, tf = segment.places[at], segment.tf[at]
                scores = np.bincount(places, weights=tf, minlength=n)
                good = np.bincount(places, minlength=n) == len(runs)
                best.add(j, segment.ids, scores, np.flatnonzero(good if fits is None else good & fits[j]))

        return work

    return _asked(index, queries, k, block, F.col("terms"), score, ("runs", "counts", "places", "tf", "most"))


def full_text_or(queries: DataFrame, index: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """search.full_text_or from the index: the first k texts by id that have any of a question's `terms`. Of a segment only texts before the last of the k-th so far are looked at."""

    def score(questions: list[tuple]) -> Callable:
        terms, own, starts, asking = _listed(questions)

        def work(segment: Segment, fits: np.ndarray | None, best: Best) -> None:
            n = len(segment.ids)
            until = max((bisect_left(segment.ids, best.held[j][-1][1]) if len(best.held[j]) == k else n for j in asking.tolist()), default=0)
            if not until:
                return
            known = segment.known(terms)
            bits = segment.bits(known[known >= 0], until)
            where = np.zeros((len(terms), bits.shape[1]), np.uint8)
            where[known >= 0] = bits
            any_ = np.bitwise_or.reduceat(where[own], starts, axis=0) if len(own) else where
            for j, line in zip(asking.tolist(), np.unpackbits(any_, axis=1)[:, :n].astype(bool), strict=False):
                places = np.flatnonzero(line if fits is None else line & fits[j])[:k]
                if len(places):
                    best.add(j, segment.ids, np.zeros(n), places)

        return work

    return _asked(index, queries, k, block, F.col("terms"), score).drop("score")
