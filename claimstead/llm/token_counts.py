"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, sliced, texts
from .pretokens import Encoder, Lengths

#: Documents that the frequent table is drawn from, in expectation, and its entries at most. They change no count, only speed.
SAMPLE_DOCS, FREQUENT = 2_000, 30_000


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = FREQUENT) -> tuple[str, bytes]:
    """The compact table: frequent pre-tokens of a bounded sample in one text, a NUL between two, and a byte each for their lengths."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(path), Counter()
        for batch in batches:
            for text in texts(batch):
                if encoder.plain(text):
                    seen.update(encoder.pretokens(text))
                if len(seen) > 20 * entries:
                    seen = Counter(dict(seen.most_common(entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])

    rows = max(1, docs.count())
    share = min(1.0, sample_docs / rows)
    # drawn by all tasks and written, so that only the sample, which is bounded whatever the input, passes the few tasks that tally it
    drawn = cut(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text"))
    seen: Counter = Counter()
    for row in drawn.coalesce(4).mapInArrow(tally, "token string, n long").collect():
        seen[row["token"]] += row["n"]
    encoder = Encoder(path)  # on the driver, for a bounded number of pre-tokens
    table = [(t, n) for t, _ in seen.most_common(entries) if "\0" not in t and (n := len(encoder.ids(t))) < 256]
    return "\0".join(t for t, _ in table), bytes(n for _, n in table)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit by the word vocabulary at path: a row per row of docs, in one pass without a shuffle.

    The driver broadcasts the lengths of at most FREQUENT frequent pre-tokens (under a MB); a worker encodes other pre-tokens once
    and caches them, up to a bound. Counts are those of the library on the whole text. Null texts count as empty: no bytes, no
    tokens. Repeated rows are counted alike, extra columns are not read, an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes = held.value
        lengths = Lengths(Encoder(path), dict(zip(words.split("\0"), sizes, strict=True)) if sizes else {})
        for batch in sliced(batches):
            found = texts(batch)
            tokens = lengths.counts(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in found], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
