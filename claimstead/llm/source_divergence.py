"""Divergence of sources: term probabilities of every (language, source) against the other sources and the language, by products of one-hot count levels."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, sliced, small

#: Documents of a language that a kept term is in at least, what is added to every count, the scale of probabilities, ranks of the terms listed.
LEAST_DOCS, ADDED, SCALE, TERMS = 30, 5, 1_000_000_000, 50
#: Terms of a block (rows of a one-hot matrix) in expectation, and sources of a side of it.
BLOCK, SIDE = 128, 32
#: Entries up to which a task sums counts before it hands them on.
HELD = 400_000

# bytes of terms stay, A-Z in lower case; all other ASCII becomes a space
_KEEP = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs summed over the task's rows as far as so many entries; term is null for a group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array([t and t.decode() for t in terms], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in sliced(batches, rows=4096):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held[lang, source]
            own = text.encode().translate(_KEEP).split()
            n.update(own)
            docs.update(set(own))
        if sum(len(n) for n, _ in held.values()) > entries:
            yield from told()
    yield from told()


def term_counts(docs: DataFrame, entries: int = HELD) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term of each group; a row with a null term tells of the group itself.

    Rows come dealt by (lang, term), so that what follows by term needs no further exchange.
    """
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = text.mapInArrow(lambda batches: _count(batches, entries), "lang string, source string, term string, n long, docs long")
    return counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * kept)), in whole numbers of 38 digits."""
    exact = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", exact(F.lit(SCALE)) * exact(n + ADDED), exact(total + ADDED * kept))
    return (1 + whole).cast("long")


def levels(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept cells (lang, source, term, n, p, q) and groups (lang, source, kept, p0): p is the group's probability at the cell's count, q the language's, p0 the group's of terms that it hasn't; null where no term is kept."""
    own = Window.partitionBy("lang", "term")
    kept = cut(counts.withColumns({"lang_docs": F.sum("docs").over(own), "lang_n": F.sum("n").over(own)}).where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)))
    cells = kept.where("term IS NOT NULL")
    # a row a language and a row a group: sums are combined before the shuffle
    of_lang = cut(cells.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total")))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = kept.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(small(of_lang), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("lang_total", F.lit(0)).cast("long").alias("lang_total"))
    groups = groups.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))))
    groups = cut(groups.withColumn("place", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")))
    told = cells.join(small(groups.select("lang", "source", "total", "kept", "lang_total", "place")), ["lang", "source"])
    priced = told.select("lang", "source", "place", "kept", "term", "n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return cut(priced), groups


def _product(frame: pd.DataFrame, side: int) -> pd.DataFrame:
    """Of one block of terms and two sides of sources: the sum of abs(p - q) over the block's terms for every pair of a source of either side.

    A column of the one-hot matrix is a (source, level), a level being the probability at a count, 1 in the rows of the terms that the source has
    that often. The matrix times its transpose counts, for two columns, the terms that have both levels: the pair's joint table, which is priced at
    once. Terms that no source of the block has are all at level 0. Products of zeros and ones are exact in single precision up to 2^24 terms.
    """
    lang, first, second = frame["lang"].iat[0], int(frame["a"].iat[0]), int(frame["b"].iat[0])
    heads = frame[frame["term"].isna()].sort_values("place")
    cells = frame[frame["term"].notna()]
    places, block = heads["place"].to_numpy(), int(heads["rows"].iat[0])
    rows, at = pd.factorize(cells["term"])[0], np.searchsorted(places, cells["place"].to_numpy())
    held = int(rows.max()) + 1 if len(rows) else 0
    p = np.repeat(heads["p"].to_numpy(np.int64)[None, :], held + 1, axis=0)  # the last row stands for the terms without a cell
    p[rows, at] = cells["p"].to_numpy(np.int64)
    times = np.r_[np.ones(held, np.int64), block - held]
    column, owner, price = np.empty(p.shape, np.int64), [], []
    for i in range(len(places)):
        level, code = np.unique(p[:, i], return_inverse=True)
        column[:, i] = len(price) + code
        price += level.tolist()
        owner += [i] * len(level)
    owner_, price_ = np.array(owner), np.array(price, np.int64)
    hot = np.zeros((held + 1, len(price)), np.float32)
    np.put_along_axis(hot, column, 1, axis=1)
    left = np.flatnonzero(places // side == first)
    right = np.flatnonzero(places // side == second)
    ends = np.searchsorted(owner_, np.arange(len(places) + 1))
    value = np.zeros((len(left), len(right)), np.int64)
    of_right = slice(ends[right[0]], ends[right[-1] + 1]) if len(right) else slice(0, 0)
    begins = (ends[right] - of_right.start) if len(right) else []
    # the rest's row weighs as many terms as it stands for, whole numbers beyond single precision kept apart
    for k, i in enumerate(left):
        mine = slice(ends[i], ends[i + 1])
        joint = (hot[:held, mine].T @ hot[:held, of_right]).astype(np.int64)
        joint += times[held] * (hot[held, mine][:, None] * hot[held, of_right][None, :]).astype(np.int64)
        value[k] = np.add.reduceat((joint * np.abs(price_[mine][:, None] - price_[of_right][None, :])).sum(axis=0), begins) if len(begins) else 0
    i, j = np.meshgrid(places[left], places[right], indexing="ij")
    return pd.DataFrame({"lang": lang, "i": i.ravel(), "j": j.ravel(), "value": value.ravel()})


def pair_values(cells: DataFrame, groups: DataFrame, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """lang, source, item, value: for every pair of different sources of a language, either way round, the summed distance of their probabilities.

    Terms go to blocks by a hash and sources to sides of `side`; each (block, side, side) is one small matrix product. Its rows are the block's cells of both
    sides and a head for each source, so a task's input is bounded whatever the sizes of languages and sources.
    """
    blocks = F.greatest(F.ceil(F.col("kept") / block), F.lit(1)).cast("int")
    sides = groups.groupBy("lang").agg(F.max(F.floor(F.col("place") / side)).cast("int").alias("last"), F.first("kept").alias("kept"))
    sides = cut(sides)
    in_block = cells.select("lang", "kept", "term", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "place", "p")
    held = in_block.groupBy("lang", "block", "term").agg(F.lit(1).alias("one")).groupBy("lang", "block").agg(F.count(F.lit(1)).alias("rows"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).join(held, ["lang", "block"], "left")
    heads = heads.select("lang", F.lit(None).cast("string").alias("term"), "block", "place", F.coalesce("p0", F.lit(0)).alias("p"), F.coalesce("rows", F.lit(0)).alias("rows"))
    rows = heads.unionByName(in_block.select("lang", "term", "block", "place", "p", F.lit(0).cast("long").alias("rows")))
    own = F.floor(F.col("place") / side).cast("int")
    dealt = rows.join(small(sides.select("lang", "last")), "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("lang", "block", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), "term", "place", "p", "rows")
    found = dealt.groupBy("lang", "block", "a", "b").applyInPandas(lambda frame: _product(frame, side), "lang string, i int, j int, value long")
    # a side with itself gives both orders of a pair, two sides one
    one = cut(found.groupBy("lang", "i", "j").agg(F.sum("value").alias("value")).where("i <> j"))
    both = one.unionByName(one.where(F.floor(F.col("i") / side) != F.floor(F.col("j") / side)).select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    name = lambda place, as_: small(groups.select("lang", F.col("place").alias(place), F.col("source").alias(as_)))
    return both.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", "item", "value")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance to every other source of its language, and the terms that it has more of than its language.

    Null text, lang and source count as ''; a repeated row counts again; texts are read whole; a group without terms, or a language without kept ones, is
    there with all its pairs. An empty table gives no rows. Ties go by the item's UTF-8 bytes. Other columns are not read.
    """
    cells, groups = levels(term_counts(docs), least_docs)
    pairs = pair_values(cells, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    more = cells.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= terms))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT f.lang, f.source, term, n, 1 + CAST({SCALE} AS HUGEINT) * (n + {ADDED}) // (sum(n) OVER (PARTITION BY f.lang, f.source) + {ADDED} * v.v) AS p, 1 + CAST({SCALE} AS HUGEINT) * (lang_n + {ADDED}) // (v.total + {ADDED} * v.v) AS q FROM f JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {TERMS}"""
