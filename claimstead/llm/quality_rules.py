"""Quality rules with distribution divergence from language references. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, small

#: Common words of a language in its histogram, and letters that such a word has at most.
COMMON, LETTERS = 12, 4

#: Share of a language's short words below which a word isn't common, so that few are ranked.
LEAST_SHARE = 0.002

#: Words of the repeated windows.
SPAN = 5


def repeated_words(words: str) -> list[tuple[str, Column]]:
    """Columns that, added one after another, end in n_repeat_words: words inside a SPAN-word window that the text has twice.

    Windows are compared by a 64-bit hash of their words' hashes. Most texts have no repeated window, which a count of distinct
    hashes shows; the others sort (hash, position), keep positions whose neighbour has the same hash, and sum the lengths of the
    union of their windows.
    """
    w = F.col(words)
    n = F.size(w)
    hashes = F.when(n >= SPAN, F.transform(w, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
    windows = F.transform(
        F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(SPAN)]),
    )
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    ordered = F.when(some, F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    at = lambda i: F.get(F.col("_s"), i)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.coalesce((at(i) == at(i - 1)) | (at(i) == at(i + 1)), at(i) == at(i - 1), at(i) == at(i + 1), F.lit(False)))
    starts = F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda i: F.get(F.col("_s"), i)["i"])))
    p = F.col("_p")
    gaps = F.when(
        F.size(p) > 1,
        F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(SPAN), lambda a, k: a + F.least(F.lit(SPAN), F.get(p, k) - F.get(p, k - 1))),
    )
    return [("_h", hashes), ("_w", windows), ("_s", ordered), ("_p", starts), ("n_repeat_words", F.coalesce(gaps, F.lit(0)).cast("long"))]


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """The COMMON most frequent words of at most LETTERS letters, lower-cased, of each language, over all documents that name one; ties go by word.

    Words are counted before the shuffle; only those over LEAST_SHARE, a few hundred a language at most, are ranked, and the driver gets COMMON of them a language.
    """
    short = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) <= LETTERS) & w.rlike(r"^\p{L}+$"))
    counts = cut(docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.explode_outer(short).alias("word")).where("word IS NOT NULL").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    totals = cut(counts.groupBy(F.col("lang").alias("_of")).agg(F.sum("n").alias("total")))
    some = counts.join(small(totals), F.col("lang") == F.col("_of")).where(F.col("n") >= LEAST_SHARE * F.col("total"))
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON)
    found: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "place").select("lang", "word").collect():
        found.setdefault(r["lang"], []).append(r["word"])
    return found


def _histogram(text: str, words: str, listed: list[str]) -> tuple[Column, Column]:
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    upper, digit, marks, high = left("[^A-Z]+"), left("[^0-9]+"), left(r"[^!-/:-@\[-`{-~]+"), left(r"[\x00-\x7F]+")
    blank = F.length(F.col(text)) - F.col("word_chars")
    classes = F.array(upper, digit, marks, high, blank.cast("int"))
    picked = F.filter(F.transform(F.filter(words, lambda w: F.length(w) <= LETTERS), F.lower), lambda w: w.isin(listed) if listed else F.lit(False))
    return classes, picked


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of two count arrays of equal length; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    pair = F.zip_with(p, q, lambda a, b: F.struct((a / total(p)).alias("a"), (b / total(q)).alias("b")))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.aggregate(pair, F.lit(0.0), lambda s, x: s + part(x["a"], (x["a"] + x["b"]) / 2) / 2 + part(x["b"], (x["a"] + x["b"]) / 2) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(both, F.lit(0.0))))


def quality_rules(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, guard_words: int = 50, max_class_distance: float = 0.26, max_word_distance: float = 0.3, common: dict[str, list[str]] | None = None) -> DataFrame:
    """Base counts, base_failed, distances to the references of the document's language, and the verdict kept. A row per row of docs.

    Histograms: six character classes (lower-case and other, upper-case, digits, ASCII marks, non-ASCII, white space), and the
    common words of the language (learned by common_words unless given), with the rest as one more bin. A language's reference sums the histograms of all its documents
    that pass the base rules; documents without a language, use all documents and skip the word test. A text of fewer than guard_words words is kept on the base rules alone.

    Whole texts are counted, however long. Null or empty texts have no words and fail the base rules. Repeated rows are judged alike. A language whose documents all fail
    has no reference, so only the base rules count. Extra columns are not read; an empty table gives an empty result.
    """
    common = common_words(docs) if common is None else common
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", text.alias("_t")).withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long"),
        "_lines": lines,
    })
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    for name, value in repeated_words("_words"):
        df = df.withColumn(name, value)
    classes, picked = _histogram("_t", "_words", sorted({x for v in common.values() for x in v}))
    df = df.withColumns({"_classes": classes, "_picked": picked})
    # the lists are one constant map, looked up once a row; each pass over the picked words is short, as only listed words are left
    lists = F.create_map(*[x for lang, listed in common.items() for x in (F.lit(lang), F.lit(listed))]) if common else F.lit(None).cast("map<string, array<string>>")
    df = df.withColumn("_listed", F.try_element_at(lists, F.col("lang")))
    own = F.transform("_listed", lambda x: F.size(F.filter("_picked", lambda w: w == x)))
    df = df.withColumn("_common", F.concat(own, F.array_repeat(F.lit(0), F.lit(COMMON) - F.size("_listed"))))
    n, r = F.col("n_words"), F.col("n_repeat_words")
    lower = (F.length("_t") - F.aggregate("_classes", F.lit(0), lambda a, v: a + v)).cast("double")
    rest = (n - F.aggregate("_common", F.lit(0), lambda a, v: a + v)).cast("double")
    facts = df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < min_words) | (100 * r > max_repeat_percent * n)).alias("base_failed"),
        F.concat(F.transform("_classes", lambda v: v.cast("double")), F.array(lower)).alias("_class_bins"),
        F.concat(F.transform("_common", lambda v: v.cast("double")), F.array(rest)).alias("_word_bins"),
    )
    facts = cut(facts)

    n_class, n_word = 6, 1 + COMMON
    good = facts.where(~F.col("base_failed"))
    sums = [F.sum(F.get("_class_bins", F.lit(i))).alias(f"c{i}") for i in range(n_class)] + [F.sum(F.get("_word_bins", F.lit(i))).alias(f"w{i}") for i in range(n_word)]
    by_lang = good.groupBy("lang").agg(*sums)
    known = F.col("lang").isin(list(common)) if common else F.lit(False)
    class_ref = F.array(*[F.col(f"c{i}") for i in range(n_class)])
    word_ref = F.array(*[F.coalesce(F.col(f"w{i}"), F.lit(0.0)) for i in range(n_word)])
    references = by_lang.select(F.col("lang").alias("_of"), class_ref.alias("_class_ref"), F.when(known, word_ref).alias("_word_ref"))
    every = good.agg(*sums).select(class_ref.alias("_all_ref"))
    out = facts.join(small(cut(references)), facts["lang"].eqNullSafe(F.col("_of")), "left").join(F.broadcast(every))
    no_lang = F.col("lang").isNull()
    out = out.withColumn("class_distance", divergence(F.col("_class_bins"), F.when(no_lang, F.col("_all_ref")).otherwise(F.col("_class_ref"))))
    out = out.withColumn("word_distance", divergence(F.col("_word_bins"), F.col("_word_ref")))
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > max_class_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word_distance)
    kept = ~F.col("base_failed") & ((n < guard_words) | ~far)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("class_distance", "word_distance")


_COUNTS = ", ".join(f"CASE WHEN listed IS NOT NULL THEN len(list_filter(words, lambda w: coalesce(lower(w) = listed[{i + 1}], FALSE))) END AS b{i}" for i in range(COMMON))
_LISTS = ", ".join(f"sum(b{i})" for i in range(COMMON))
OP8_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), freq AS (
  SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_filter(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+'), lambda w: regexp_full_match(w, '\p{{L}}{{1,4}}'))) AS w FROM base WHERE lang IS NOT NULL) GROUP BY ALL
), top AS (
  SELECT lang AS of, list(w ORDER BY place) AS listed FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS place FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM freq) WHERE n >= 0.002 * total) WHERE place <= 12 GROUP BY lang
), win AS (
  SELECT *, row_number() OVER () AS rid,
    list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i+4], ' ')) AS ws FROM base
), flat AS (
  SELECT rid, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM win
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM flat) WHERE c > 1
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) AS o(k) GROUP BY rid
), facts AS (
  SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS c0, length(regexp_replace(t, '[^0-9]', '', 'g')) AS c1,
    length(regexp_replace(t, '[^!-/:-@\[-`{{-~]', '', 'g')) AS c2, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS c3,
    length(t) - length(array_to_string(words, '')) AS c4, length(t) AS n_all,
    {_COUNTS}
  FROM win LEFT JOIN cover c USING (rid) LEFT JOIN top ON of = lang
), bins AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [c0, c1, c2, c3, c4, n_all - c0 - c1 - c2 - c3 - c4] AS p,
    CASE WHEN b0 IS NOT NULL THEN [b0, b1, b2, b3, b4, b5, b6, b7, b8, b9, b10, b11, n_words - (b0 + b1 + b2 + b3 + b4 + b5 + b6 + b7 + b8 + b9 + b10 + b11)] END AS v
  FROM facts
), refs AS (
  SELECT lang, [sum(c0), sum(c1), sum(c2), sum(c3), sum(c4), sum(n_all - c0 - c1 - c2 - c3 - c4)] AS q,
    [{_LISTS}, sum(n_words - (b0 + b1 + b2 + b3 + b4 + b5 + b6 + b7 + b8 + b9 + b10 + b11))] AS u
  FROM bins WHERE NOT base_failed GROUP BY lang
), allref AS (
  SELECT [sum(c0), sum(c1), sum(c2), sum(c3), sum(c4), sum(n_all - c0 - c1 - c2 - c3 - c4)] AS q FROM bins WHERE NOT base_failed
), compared AS (
  SELECT b.*, list_transform(b.p, lambda x: x / CAST(list_sum(b.p) AS DOUBLE)) AS pp,
    list_transform(CASE WHEN b.lang IS NULL THEN a.q ELSE r.q END, lambda x: x / CAST(list_sum(CASE WHEN b.lang IS NULL THEN a.q ELSE r.q END) AS DOUBLE)) AS qq,
    list_transform(b.v, lambda x: x / CAST(list_sum(b.v) AS DOUBLE)) AS vv,
    list_transform(r.u, lambda x: x / CAST(list_sum(r.u) AS DOUBLE)) AS uu
  FROM bins b LEFT JOIN refs r ON b.lang IS NOT DISTINCT FROM r.lang CROSS JOIN allref a
), dist AS (
  SELECT *,
    sqrt(list_sum(list_transform(generate_series(1, 6), lambda i: (CASE WHEN pp[i] > 0 THEN pp[i] * log2(pp[i] / ((pp[i] + qq[i]) / 2)) ELSE 0 END + CASE WHEN qq[i] > 0 THEN qq[i] * log2(qq[i] / ((pp[i] + qq[i]) / 2)) ELSE 0 END) / 2))) AS dc,
    sqrt(list_sum(list_transform(generate_series(1, 13), lambda i: (CASE WHEN vv[i] > 0 THEN vv[i] * log2(vv[i] / ((vv[i] + uu[i]) / 2)) ELSE 0 END + CASE WHEN uu[i] > 0 THEN uu[i] * log2(uu[i] / ((vv[i] + uu[i]) / 2)) ELSE 0 END) / 2))) AS dw
  FROM compared
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < 50 OR NOT (coalesce(dc, 0) > 0.26 OR coalesce(dw, 0) > 0.3)) AS kept
FROM dist
"""
