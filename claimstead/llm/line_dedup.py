"""Line dedup: winnowing over hashes of lines and of the sentences in them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, documents, small, word_count

#: A piece is a line, or a sentence of it, cut after 16 words.
PIECE = r"[^\x20\x09-\x0D]++(?:(?<![.!?])[\x20\x09\x0B-\x0D]++[^\x20\x09-\x0D]++){0,15}+"

#: Pieces of a winnowing window. A run of 50 words has 20 in whole pieces, so mostly three of them.
WINDOW = 3

#: Bytes below which a piece is chosen only where its window has no longer one.
SHORT = 24

#: Later places of one fingerprint that one row of its first place serves; a fingerprint of more is dealt out by a hash.
PLACES = 500


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _rank(piece: Column) -> Column:
    """60 bits of the MD5 of a piece; short pieces rank behind all others."""
    digest = F.conv(F.substring(F.md5(piece.cast("binary")), 1, 15), 16, 10).cast("long")
    return digest + F.when(F.octet_length(piece) < SHORT, F.lit(1 << 60)).otherwise(F.lit(0).cast("long"))


def _chosen(ranks: Column, k: Column) -> Column:
    """Whether one of the windows that hold piece k has it for its last piece of least rank."""
    own, some = F.get(ranks, k), F.lit(False)
    for start in range(1 - WINDOW, 1):
        least = F.lit(True)
        for i in range(start, start + WINDOW):
            least = least & (F.lit(True) if i == 0 else own <= F.get(ranks, k + i) if i < 0 else own < F.get(ranks, k + i))
        some = some | least
    return some


def fingerprints(text: Column) -> Column:
    """ks, marks: the pieces that some window of WINDOW consecutive pieces chose, and their ranks."""
    spots = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: _chosen(r, k))
    both = lambda r: F.when(F.size(r) >= WINDOW, let(spots(r), lambda ks: F.struct(ks.alias("ks"), F.transform(ks, lambda k: F.get(r, k)).alias("marks"))))
    return let(F.transform(pieces(text), _rank), both)


def _measured(text: Column) -> Column:
    """h: a hash of each word of the text; at: the word that each piece starts at, and the number of words."""
    words = F.transform(pieces(text), lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))
    owners = lambda w: F.flatten(F.transform(w, lambda x, k: F.array_repeat(k, F.size(x))))
    # starts are told by the owner before, in one walk over the words
    starts = lambda of: F.concat(F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: ~F.get(of, i).eqNullSafe(F.get(of, i - 1))), F.array(F.size(of)))
    return let(words, lambda w: F.struct(F.transform(F.flatten(w), lambda x: F.hash(x)).alias("h"), let(owners(w), starts).alias("at")))


def _place(m: Column, k: Column) -> Column:
    """a, b: the first word of piece k and the one behind its last."""
    return F.struct(F.get(m["at"], k).alias("a"), F.get(m["at"], k + 1).alias("b"))


def _around(m: Column, p: Column, reach: int) -> tuple[Column, Column]:
    """Hashes of the `reach` words before the place p, nearest first, and of those after it."""
    return F.reverse(F.slice(m["h"], F.greatest(p["a"] - reach, F.lit(0)) + 1, F.least(p["a"], F.lit(reach)))), F.slice(m["h"], p["b"] + 1, reach)


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    return let(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False), lambda at: F.when(at > 0, at - 1).otherwise(F.size(b)).cast("int"))


def _gone(m: Column, hits: Column, min_words: int) -> Column:
    """The words of hits [k, before, after] whose match, extended over equal words on both sides, has min_words words or more."""

    def extended(x: Column, p: Column) -> Column:
        before, after = _around(m, p, min_words)
        return F.struct((p["a"] - _common(before, x["before"])).alias("a"), (p["b"] + _common(after, x["after"])).alias("b"))

    def span(x: Column) -> Column:
        return let(_place(m, x["k"]), lambda p: extended(x, p))

    wide = F.filter(F.transform(hits, span), lambda s: s["b"] - s["a"] >= min_words)
    return F.array_distinct(F.flatten(F.transform(wide, lambda s: F.sequence(s["a"], s["b"] - 1))))


def _left(text: Column, gone: Column) -> Column:
    """The text without the words `gone`, each with the white space before it; white space at an end stays only with the end's word."""
    tokens = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))

    def joined(t: Column, kept: Column) -> Column:
        body = F.array_join(F.transform(kept, lambda i: F.get(t, i)), "")
        trimmed = let(body, lambda x: F.when(F.get(kept, F.lit(0)) > 0, F.regexp_replace(x, r"\A[\x20\x09-\x0D]+", "")).otherwise(x))
        tail = F.when(F.element_at(kept, -1) == F.size(t) - 1, F.regexp_extract(text, r"[\x20\x09-\x0D]*\z", 0)).otherwise("")
        return F.when(F.size(kept) == 0, "").otherwise(F.concat(trimmed, tail))

    return let(tokens, lambda t: let(F.array_except(F.sequence(F.lit(0), F.size(t) - 1), gone), lambda kept: joined(t, kept)))


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with text without later repeats of runs of min_words or more words, and n_removed, the words that went.

    Texts are cut into pieces: lines, and sentences in them. Of each window of consecutive pieces the least hash is a fingerprint, so a
    run that holds a whole window shares one with each of its repeats. Fingerprints that occur once in the corpus are dropped. Each
    place of another is joined with the first, in the order of (doc_id, hash of the text, piece), and the match is extended word by word
    both ways, up to min_words on a side; longer runs are covered by their next fingerprints. A match of min_words or more is deleted at
    its later place, white space before its words too. Places are never paired with each other, only with the first of their fingerprint,
    so a run that shares none of its fingerprints' first places stays. Of texts that are equal and have min_words or more, the first stays, others become empty.

    Null texts stay null; texts of fewer than min_words words are never changed; very long texts are taken whole. Rows with equal doc_id
    and text count as one document and get the same result. Words are compared by a 32-bit hash next to an equal piece. Other columns
    are kept, but for one named n_removed. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # null-free keys, so that joins need no null-safe comparison and their partitioning serves grouping too: a document is told by its
    # doc_id and 32 bits (of a hash of its text, the last one told by a null doc_id), a place by these and, in one long with the bits, the piece
    key, tie = ["_id", "_t"], F.xxhash64(F.coalesce("text", F.lit("")))
    row = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")] if others else []
    keyed = docs.select(*row, "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), (tie.bitwiseAND(F.lit((1 << 31) - 1)) * 2 + F.col("doc_id").isNull().cast("long")).alias("_t"))

    text = F.coalesce("text", F.lit(""))
    found = cut(keyed.select(*key, F.xxhash64(text).alias("tie"), fingerprints(text).alias("f")).select(*key, "tie", "f.ks", "f.marks"))
    alike = found.groupBy("tie").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    alike = small(cut(alike.select(F.col("tie").alias("of"), "first")))
    met = found.join(alike, F.col("tie") == F.col("of"), "left")
    copies = met.where("of IS NOT NULL AND _id <> first").select(*key).distinct()
    spread = lambda df: df.select("_id", "_t", F.inline(F.arrays_zip("marks", "ks"))).select(F.col("marks").alias("mark"), "_id", F.shiftleft("_t", 32).bitwiseOR(F.col("ks").cast("long")).alias("_at"))
    # rows of one document that is there twice count once
    rows = spread(met.where("of IS NULL")).unionByName(spread(met.where("of IS NOT NULL AND _id = first").dropDuplicates(["tie"])))
    again = cut(rows.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("mark"))
    # scans of their own, so that Spark can split the other side of a join where one mark has very many rows
    spots = cut(rows.join(again, "mark", "left_semi"))
    place = F.struct("_id", "_at")
    first = spots.groupBy("mark").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    first = cut(first.select("mark", "first", F.ceil(F.col("times") / PLACES).cast("int").alias("parts")))
    document, piece = F.shiftrightunsigned("_at", 32).alias("_t"), F.col("_at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("k")
    later = spots.join(first, "mark").where(place != F.col("first")).select("mark", F.pmod(F.xxhash64("_id", "_at"), F.col("parts")).cast("int").alias("part"), "_id", document, piece)

    asked = first.select("mark", "parts", "first.*").select("mark", "parts", "_id", document, piece).groupBy(*key).agg(F.collect_list(F.struct("mark", "parts", "k")).alias("asked"))
    holders = keyed.select("text", *key).join(asked, key).dropDuplicates(key)

    def shown(m: Column) -> Column:
        def one(x: Column, p: Column) -> Column:
            before, after = _around(m, p, min_words)
            return F.struct(x["mark"].alias("mark"), x["parts"].alias("parts"), before.alias("before"), after.alias("after"))

        return F.transform("asked", lambda x: let(_place(m, x["k"]), lambda p: one(x, p)))

    # inline_outer, as inline adds a filter on the array's size that works it out once more
    context = holders.select(F.inline_outer(let(_measured(F.col("text")), shown))).where("mark IS NOT NULL")
    context = context.select("mark", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "before", "after")
    hits = later.join(context, ["mark", "part"]).groupBy(*key).agg(F.collect_list(F.struct("k", "before", "after")).alias("hits"))
    hits = hits.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    own = F.col("text")
    gone = F.when(F.col("copy"), F.when(word_count(own) >= min_words, F.sequence(F.lit(0), word_count(own).cast("int") - 1)))
    out = keyed.join(hits, key, "left").withColumn("_gone", gone.when(F.col("hits").isNotNull(), let(_measured(own), lambda m: _gone(m, F.col("hits"), min_words))))
    n_removed = F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(0).cast("long")
    new = {"text": F.when(F.size("_gone") > 0, _left(own, F.col("_gone"))).otherwise(own), "doc_id": F.when(F.col("_t") % 2 == 0, F.col("_id"))}
    return out.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns if c != "n_removed"], n_removed.alias("n_removed"))


def op2_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS tokens, regexp_extract(coalesce(text, ''), '[\x20\x09-\x0D]*\z') AS tail,
    row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents
), tok AS (
  SELECT doc_id, nth, unnest(tokens) AS token, unnest(generate_series(0, len(tokens) - 1)) AS i FROM base
), word AS (
  SELECT doc_id, nth, i, trim(token, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w, contains(token, chr(10)) AS new_line FROM tok
), broken AS (
  SELECT *, CASE WHEN new_line OR regexp_matches(lag(w) OVER (PARTITION BY doc_id ORDER BY i), '[.!?]$') THEN 1 ELSE 0 END AS b FROM word
), seg AS (
  SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM broken
), part AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, s ORDER BY i) - 1) // 16 AS c FROM seg
), piece AS (
  SELECT doc_id, min(i) AS a, count(*) AS n, trim(string_agg(token, '' ORDER BY i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS piece FROM part JOIN tok USING (doc_id, i) WHERE part.nth = 1 GROUP BY doc_id, s, c
), ranked AS (
  SELECT doc_id, a, n, CAST(CAST('0x' || substr(md5(piece), 1, 15) AS BIGINT) AS HUGEINT) + CASE WHEN strlen(piece) < 24 THEN 1152921504606846976 ELSE 0 END AS r, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM piece
), win AS (
  SELECT x.doc_id, x.k, y.r, y.k AS spot, count(*) OVER (PARTITION BY x.doc_id, x.k) AS pieces FROM ranked x JOIN ranked y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k AND x.k + 2
), mark AS (
  SELECT DISTINCT doc_id, spot FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY doc_id, k ORDER BY r, spot DESC) AS best FROM win WHERE pieces = 3) WHERE best = 1
), place AS (
  SELECT m.doc_id, r.a, r.n, r.r, row_number() OVER (PARTITION BY r.r ORDER BY m.doc_id, r.a) AS nth FROM mark m JOIN ranked r ON m.doc_id = r.doc_id AND m.spot = r.k
), pair AS (
  SELECT l.doc_id, l.a, l.n, f.doc_id AS of_id, f.a AS of_a FROM place l JOIN place f ON l.r = f.r AND f.nth = 1 AND l.nth > 1
), off AS (
  SELECT p.doc_id, p.a, p.n, d.d, x.w IS NOT NULL AND x.w IS NOT DISTINCT FROM y.w AS same FROM pair p
  CROSS JOIN (SELECT unnest(generate_series(1, 50)) AS d UNION ALL SELECT unnest(generate_series(-50, -1))) d
  LEFT JOIN word x ON x.doc_id = p.doc_id AND x.i = p.a + CASE WHEN d.d > 0 THEN p.n - 1 ELSE 0 END + d.d
  LEFT JOIN word y ON y.doc_id = p.of_id AND y.i = p.of_a + CASE WHEN d.d > 0 THEN p.n - 1 ELSE 0 END + d.d
), reach AS (
  SELECT doc_id, a, n, coalesce(min(d) FILTER (NOT same AND d > 0) - 1, 50) AS r, coalesce(-1 - max(d) FILTER (NOT same AND d < 0), 50) AS l FROM off GROUP BY doc_id, a, n
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(a - l, a + n + r - 1)) AS i FROM reach WHERE l + n + r >= 50
  UNION SELECT doc_id, unnest(generate_series(0, len(tokens) - 1)) FROM base WHERE nth > 1 AND len(tokens) >= 50
), kept AS (
  SELECT t.doc_id, string_agg(t.token, '' ORDER BY t.i) AS body, min(t.i) AS low, max(t.i) AS high FROM tok t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT b.doc_id, CASE WHEN r.n IS NULL THEN b.text WHEN k.body IS NULL THEN ''
    ELSE concat(CASE WHEN k.low > 0 THEN ltrim(k.body, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE k.body END, CASE WHEN k.high = len(b.tokens) - 1 THEN b.tail ELSE '' END) END AS text, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed
FROM base b LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
