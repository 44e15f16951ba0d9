"""Document fingerprints: a Merkle tree over paragraphs and sections, compared from the root down. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, small

#: A paragraph: 40 characters, then up to the end of a sentence or line, 160 at most; the last one of a text may be shorter.
PARAGRAPH = r"[\s\S]{40}[^.!?\n]{0,120}[.!?\n]?|[\s\S]+"

#: A section, over nodes of 16 hex digits: up to a node whose last digit is under 4, 16 nodes at most. So sections end by content.
SECTION = "(?:[0-9a-f]{15}[4-9a-f]){0,15}[0-9a-f]{16}"

#: Hex digits of the labels of root, section and paragraph in a fingerprint. Each node covers the 16 digits of its paragraphs.
ROOT, OUTER, INNER = 32, 8, 6


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))


def tree(text: Column) -> Column:
    """Sections, each the nodes of its paragraphs one after another. Null counts as empty."""
    nodes = F.array_join(F.transform(paragraphs(text), lambda p: F.substring(F.sha2(p, 256), 1, 16)), "")
    return F.regexp_extract_all(nodes, F.lit(SECTION), F.lit(0))


def fingerprint(sections: Column) -> Column:
    """root:section/section/..., a section being its label and those of its paragraphs.

    A section's label is taken from the SHA-256 of its nodes, the root from that of all sections' SHA-256.
    """
    inner = lambda s: F.regexp_replace(s, rf"([0-9a-f]{{{INNER}}})[0-9a-f]{{{16 - INNER}}}", "$1")

    def built(all_: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(all_, lambda x: x["h"]), ""), 256)
        return F.concat(F.substring(root, 1, ROOT), F.lit(":"), F.array_join(F.transform(all_, lambda x: F.concat(F.substring(x["h"], 1, OUTER), inner(x["s"]))), "/"))

    return let(F.transform(sections, lambda s: F.struct(s.alias("s"), F.sha2(s, 256).alias("h"))), built)


def branches(print_: Column) -> Column:
    """The sections of a fingerprint in order; none for an empty text."""
    return F.filter(F.split(F.split_part(print_, F.lit(":"), F.lit(2)), "/"), lambda s: s != "")


def leaves(section: Column) -> Column:
    """The paragraph labels of a section."""
    return F.regexp_extract_all(F.substring(section, OUTER + 1, 1 << 30), F.lit(f"[0-9a-f]{{{INNER}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of paragraphs that two fingerprints have in common, 2 n / (n_a + n_b), found from the top down.

    Equal roots need no look further. Sections that both have count with all their paragraphs; only sections that differ are descended
    into, and their paragraphs compared. Repeats of a section, or of a paragraph among those that differ, count once.
    """
    count = lambda sections: F.aggregate(sections, F.lit(0), lambda n, s: n + F.floor((F.length(s) - OUTER) / INNER).cast("int"))
    below = lambda sections: F.array_distinct(F.flatten(F.transform(sections, leaves)))

    def descended(x: Column) -> Column:
        p, q = below(F.array_except(x["a"], x["b"])), below(F.array_except(x["b"], x["a"]))
        found = F.struct(count(F.array_intersect(x["a"], x["b"])).alias("same"), p.alias("p"), q.alias("q"))
        return let(found, lambda y: 2.0 * (y["same"] + F.size(F.array_intersect(y["p"], y["q"]))) / (2 * y["same"] + F.size(y["p"]) + F.size(y["q"])))

    root = lambda v: F.split_part(v, F.lit(":"), F.lit(1))
    return F.when(root(a) == root(b), 1.0).otherwise(let(F.struct(branches(a).alias("a"), branches(b).alias("b")), descended))


def edits(a: Column, b: Column) -> Column:
    """Where a differs from b: [section, paragraphs] for the sections (from 0) of fingerprint a that b lacks, with the paragraphs (from 0) that b's differing sections lack. Empty if the roots are equal."""

    def descended(x: Column) -> Column:
        others = F.flatten(F.transform(F.array_except(x["b"], x["a"]), leaves))
        changed = F.filter(F.transform(x["a"], lambda s, i: F.struct(i.alias("section"), s.alias("s"))), lambda y: ~F.array_contains(x["b"], y["s"]))

        def told(known: Column) -> Column:
            lost = lambda s: F.filter(F.transform(leaves(s), lambda p, k: F.when(~F.array_contains(known, p), k)), lambda k: k.isNotNull())
            return F.transform(changed, lambda y: F.struct(y["section"], lost(y["s"]).alias("paragraphs")))

        return let(others, told)

    root = lambda v: F.split_part(v, F.lit(":"), F.lit(1))
    none = F.array().cast("array<struct<section:int,paragraphs:array<int>>>")
    return F.when(root(a) == root(b), none).otherwise(let(F.struct(branches(a).alias("a"), branches(b).alias("b")), descended))


def successors(docs: DataFrame) -> DataFrame:
    """Per distinct (doc_id, tie) its length and that of its predecessor in ascending doc_id, the last being that of the first.

    Only ids are sorted, by ranges over all executors; a rank is the place in its range plus the sizes of the ranges before, of
    which there is one row each.
    """
    ids = docs.groupBy("doc_id", "tie").agg(F.first("n_chars").alias("n_chars"))
    placed = ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    at = F.monotonically_increasing_id()
    placed = cut(placed.withColumns({"part": F.shiftright(at, 33), "place": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cut(parts.select(F.col("part").alias("of"), before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")))
    ranked = placed.join(small(parts), F.col("part") == F.col("of")).select("doc_id", "tie", "n_chars", "total", (F.col("before") + F.col("place")).alias("rank"))
    to = ranked.select(F.col("doc_id").alias("prev_id"), F.col("tie").alias("prev_tie"), F.col("n_chars").alias("prev_chars"), F.pmod(F.col("rank") + 1, F.col("total")).alias("rank"))
    return ranked.select("doc_id", "tie", "rank").join(to, "rank").drop("rank")


def merkle_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are to each other and to the next document's.

    The edited text replaces the last quarter by the start of the next document; edited_sections names, comma-separated, the sections of the
    document that this changed. Null texts count as empty; an empty text has a root and
    no labels, and is wholly like another empty text. Very long texts are hashed whole. Rows with equal doc_id and text are one document in the order and each get its
    result; rows with equal doc_id and other texts follow by a hash of the text; a null doc_id comes first. A single document is
    followed by itself. An empty table gives an empty result; extra columns are not read.

    Texts are shuffled once, by (doc_id, hash); what moves to a document from its successor is the start it needs and a fingerprint.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumns({"tie": F.xxhash64("text"), "n_chars": F.length("text").cast("long")})
    links = cut(successors(base.select("doc_id", "tie", "n_chars")))
    keyed = base.select("doc_id", "tie", "text")
    l_ = links.withColumnsRenamed({"doc_id": "l_id", "tie": "l_tie"})
    starts = keyed.join(l_, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("tie") == F.col("l_tie")))
    starts = starts.select("prev_id", "prev_tie", F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("start"), fingerprint(tree(F.col("text"))).alias("next_fingerprint"))
    # rows of one document that is there twice give the same start twice
    starts = starts.dropDuplicates(["prev_id", "prev_tie"])
    joined = keyed.join(starts, F.col("doc_id").eqNullSafe(F.col("prev_id")) & (F.col("tie") == F.col("prev_tie")))
    n = F.length("text")
    joined = joined.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("start")))
    joined = joined.withColumns({"fingerprint": fingerprint(tree(F.col("text"))), "edited_fingerprint": fingerprint(tree(F.col("edited")))})
    return joined.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.array_join(F.transform(edits(F.col("fingerprint"), F.col("edited_fingerprint")), lambda x: x["section"].cast("string")), ",").alias("edited_sections"),
    )


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_fingerprints(documents(spark, sf_dir))


def _sql_print(text: str) -> str:
    sections = f"regexp_extract_all(array_to_string(list_transform(regexp_extract_all({text}, '{PARAGRAPH}'), lambda p: substr(sha256(p), 1, 16)), ''), '{SECTION}')"
    root = f"substr(sha256(array_to_string(list_transform({sections}, lambda s: sha256(s)), '')), 1, {ROOT})"
    inner = f"regexp_replace(s, '([0-9a-f]{{{INNER}}})[0-9a-f]{{{16 - INNER}}}', '\\1', 'g')"
    return f"concat({root}, ':', array_to_string(list_transform({sections}, lambda s: concat(substr(sha256(s), 1, {OUTER}), {inner})), '/'))"


_BRANCHES = "list_filter(string_split(split_part({}, ':', 2), '/'), lambda s: s <> '')"
_LEAVES = f"list_distinct(flatten(list_transform(list_distinct(list_filter({{a}}, lambda s: NOT list_contains({{b}}, s))), lambda s: regexp_extract_all(substr(s, {OUTER + 1}), '[0-9a-f]{{{{{INNER}}}}}'))))"


def _sql_like(a: str, b: str, name: str) -> str:
    """Two steps of the query: the shared sections' paragraphs and the differing ones, then the likeness."""
    return (
        f"{name}0 AS (SELECT doc_id, {a} AS a, {b} AS b, {_BRANCHES.format(a)} AS x, {_BRANCHES.format(b)} AS y FROM prints), "
        f"{name}1 AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(x, y), lambda s: (length(s) - {OUTER}) // {INNER})), 0) AS same, {_LEAVES.format(a='x', b='y')} AS p, {_LEAVES.format(a='y', b='x')} AS q FROM {name}0), "
        f"{name} AS (SELECT doc_id, CASE WHEN split_part(a, ':', 1) = split_part(b, ':', 1) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (same + len(list_intersect(p, q))) / (2 * same + len(p) + len(q)) END AS {name}, "
        f"array_to_string(list_transform(list_filter(generate_series(1, len(x)), lambda i: NOT list_contains(y, x[i])), lambda i: CAST(i - 1 AS VARCHAR)), ',') AS {name}_sections FROM {name}1)"
    )


OP10_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), moved AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM base
), edit AS (
  SELECT *, concat(substr(text, 1, n - n // 4), substr(following, 1, n // 4)) AS edited FROM moved
), prints AS (
  SELECT *, {_sql_print('text')} AS fingerprint, {_sql_print('edited')} AS edited_fingerprint, {_sql_print('following')} AS next_fingerprint FROM edit
), {_sql_like('fingerprint', 'edited_fingerprint', 'near_edited')}, {_sql_like('fingerprint', 'next_fingerprint', 'near_next')}
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_edited_sections AS edited_sections
FROM prints JOIN near_edited USING (doc_id) JOIN near_next USING (doc_id)
"""
