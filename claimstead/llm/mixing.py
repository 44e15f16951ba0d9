"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, small, unit, word_count

#: Bins of one refinement of the cut.
BINS = 4096

#: Significant bits of the size that a document's inclusion is in proportion to; 16 classes of sizes a doubling.
SIZE_BITS = 5


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Targets per source: the weights share all sizes, no source gets over cap times its own size.

    sizes has source and source_size, a row per source. Sources are ordered by code point, null last, and take the weights in
    turn. The common level is found in closed form: with the sources ordered by cap * size / weight, those before the first that
    stays under its cap are the capped ones; from there on the level only falls, so it is the largest of the levels that hold. The
    windows run over a row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(pick == i, w).otherwise(weight)
    limit = F.col("source_size") * cap
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", limit)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (total - before) / rest)
    free = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level"))
    level = level.withColumn("first_free", F.max(free).over(Window.partitionBy()))
    return level.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("first_free") * F.col("weight")).alias("target"))


def size_class(size: Column) -> Column:
    """The size with all but its SIZE_BITS first bits cleared, so that a source has few classes."""
    low = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))
    return (F.floor(size / F.pow(F.lit(2.0), low)) * F.pow(F.lit(2.0), low)).cast("long")


def inclusion(classes: DataFrame, left: str) -> DataFrame:
    """of, factor, top, certain: what makes a source's inclusion probabilities min(1, factor * class) sum to `left` expected words.

    classes has of, class, words and the column left, a row per source and size class, so the windows run over some hundred rows a source.
    Documents of classes above top are certain and have the words `certain`. With classes taken from the largest down, they end before the
    first class whose own probability is at most 1.
    """
    down = Window.partitionBy("of").orderBy(F.desc("class"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("class")).over(down.rowsBetween(0, Window.unboundedFollowing))
    level = classes.withColumn("before", before).withColumn("factor", (F.col(left) - F.col("before")) / rest)
    fits = level.where(F.col("factor") * F.col("class") <= 1)
    return fits.groupBy("of").agg(F.max(F.struct("class", "factor", "before")).alias("x")).select(F.col("of").alias("in_of"), "x.factor", F.col("x.class").alias("top"), F.col("x.before").alias("certain"))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, salt: str = "mix") -> DataFrame:
    """docs with size, source_size, target, inclusion, copies and taken: how often the mix takes each document.

    A source with target t and size s takes floor(t / s) whole copies of each of its documents. What is left of the target is a
    sample of unequal probabilities, without replacement: a document's inclusion p is in proportion to its size (to five bits), such that the
    expected words are what is left. Where that comes to 1 or more, the document is certain and taken whole, and the others' p grow. The rest
    is sampled by Pareto order: a document's random odds u / (1 - u) over its inclusion odds p / (1 - p) rank it in its source, and the
    lowest ranks are taken until their words come nearest to what is left. u hangs on doc_id,
    so reruns agree. No source is sorted in one task: the cut is narrowed twice by sums over BINS bins of the rank, and only
    documents of the last bin (a 16-millionth of a source) are put in order.

    Null or wordless texts have size 0 and are never taken; the null source is a source of its own; ties go by doc_id, then by a
    hash of the text; equal rows share one rank and are taken or left together; very long texts count whole. Other columns of docs are kept, but for those named as
    the new ones are. An empty table gives an empty result.
    """
    made = ["size", "source_size", "target", "inclusion", "copies", "taken"]
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_none"))
    sized = docs.select(row.alias("_row"), "doc_id", "text", "source", word_count(F.col("text")).alias("size"))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keys = cut(sized.select("doc_id", "source", "size", key.alias("tie")))
    sources = cut(source_targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    n_sources = sources.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sources.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumnsRenamed({"source": "of"})
    open_ = keys.join(small(plan, n_sources), F.col("source").eqNullSafe(F.col("of"))).where("size > 0 AND left > 0")
    classes = open_.groupBy("of", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"), F.max("left").alias("left"))
    shares = inclusion(classes, "left")
    plan = cut(plan.join(shares, F.col("of").eqNullSafe(F.col("in_of")), "left").drop("in_of"))
    plan = plan.withColumn("room", F.col("left") - F.coalesce("certain", F.lit(0)))

    p = F.when(F.col("size") > 0, F.when(size_class(F.col("size")) > F.col("top"), 1.0).otherwise(F.least(F.lit(1.0), F.col("factor") * size_class(F.col("size")))))
    p = F.coalesce(p, F.lit(0.0))

    def rank(inclusion_: Column) -> Column:
        u = unit(F.col("doc_id"), salt)
        return F.when(inclusion_ > 0, (u / (1 - u)) * ((1 - inclusion_) / inclusion_))

    open_ = keys.join(small(plan, n_sources), F.col("source").eqNullSafe(F.col("of"))).withColumn("p", p).where((F.col("p") > 0) & (size_class(F.col("size")) <= F.col("top")))
    open_ = open_.withColumn("rank", rank(F.col("p")))
    # rank / (1 + rank) lies in [0, 1) in the order of rank; its bins are narrowed around each source's cut
    at = F.col("rank") / (1 + F.col("rank")) * BINS
    open_ = open_.withColumn("bin", F.floor(at)).withColumn("fine", F.floor((at - F.col("bin")) * BINS))
    first = _straddled(open_, ["of"], "bin", F.col("room"))
    inside = open_.join(small(first, n_sources), open_["of"].eqNullSafe(first["at_of"]) & (open_["bin"] == first["at_bin"]))
    second = _straddled(inside.withColumn("inner", F.col("room") - F.col("below")).drop("at_of", "at_bin", "below"), ["of"], "fine", F.col("inner"), also="bin")
    last = inside.drop("at_of", "at_bin", "below").join(
        small(second, n_sources), F.col("of").eqNullSafe(F.col("at_of")) & (F.col("fine") == F.col("at_fine")) & (F.col("bin") == F.col("also"))
    )
    order = Window.partitionBy("of").orderBy("rank", F.col("doc_id").asc_nulls_first(), "tie")
    last = last.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = last.where(2 * F.col("upto") - F.col("size") <= 2 * (F.col("room") - F.col("base")))
    place = F.struct("rank", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"), "tie")
    cuts = chosen.groupBy("of").agg(F.max(place).alias("upto"))
    edge = second.select(F.col("at_of").alias("edge_of"), F.col("also").alias("edge_bin"), F.col("at_fine").alias("edge_fine"))
    table = plan.join(cuts.withColumnRenamed("of", "cut_of"), F.col("of").eqNullSafe(F.col("cut_of")), "left")
    table = cut(table.join(edge, F.col("of").eqNullSafe(F.col("edge_of")), "left").drop("cut_of", "edge_of"))

    out = sized.join(small(table, n_sources), sized["source"].eqNullSafe(F.col("of")), "left").withColumn("p", p).withColumn("_rank", rank(F.col("p")))
    r = F.col("_rank")
    out = out.withColumn("_at", r / (1 + r) * BINS).withColumn("_bin", F.floor("_at")).withColumn("_fine", F.floor((F.col("_at") - F.col("_bin")) * BINS))
    here = F.struct(r.alias("rank"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"), key.alias("tie"))
    below = (
        F.col("edge_bin").isNull()
        | (F.col("_bin") < F.col("edge_bin"))
        | ((F.col("_bin") == F.col("edge_bin")) & (F.col("_fine") < F.col("edge_fine")))
        | ((F.col("_bin") == F.col("edge_bin")) & (F.col("_fine") == F.col("edge_fine")) & F.coalesce(here <= F.col("upto"), F.lit(False)))
    )
    extra = F.when((F.col("p") > 0) & ((size_class(F.col("size")) > F.col("top")) | below), 1).otherwise(0)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).cast("int"))
    out = out.withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("p", "inclusion")
    kept = [c for c in docs.columns if c not in made]
    return out.select(*[F.col(c) if c in ("doc_id", "text", "source") else F.col("_row")[c].alias(c) for c in kept], *made)


def _straddled(rows: DataFrame, by: list[str], bin_: str, room: Column, also: str | None = None) -> DataFrame:
    """The bin of each source in which the running sum of sizes passes the room, and the sum below it."""
    extra = [also] if also else []
    sums = rows.withColumn("room_", room).groupBy(*by, bin_, *extra).agg(F.sum("size").alias("words"), F.min("room_").alias("room_"), F.min("room").alias("whole_room"))
    run = Window.partitionBy(*by).orderBy(bin_)
    sums = sums.withColumn("upto", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.where((F.col("upto") > F.col("room_")) & (F.col("upto") - F.col("words") <= F.col("room_")))
    columns = [F.col(by[0]).alias("at_of"), F.col(bin_).alias(f"at_{bin_}")]
    if also:
        return cut(sums.select(*columns, F.col(also).alias("also"), (F.col("upto") - F.col("words") + F.col("whole_room") - F.col("room_")).alias("base")))
    return cut(sums.select(*columns, (F.col("upto") - F.col("words")).alias("below")))


def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src
), lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ranked
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * max(CASE WHEN 3 * source_size >= level * weight THEN level END) OVER ()) AS target FROM lev
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), parts AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS whole, target - floor(rate) * source_size AS room FROM plan
), joined AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, t.whole, t.room, CAST(floor(s.size / pow(2.0, greatest(length(bin(s.size)) - 5, 0))) * pow(2.0, greatest(length(bin(s.size)) - 5, 0)) AS BIGINT) AS class,
    (CAST(CAST('0x' || substr(md5(concat(coalesce(CAST(s.doc_id AS VARCHAR), ''), ':mix')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM sized s JOIN parts t ON s.source IS NOT DISTINCT FROM t.source
), classes AS (
  SELECT source, class, CAST(sum(size) AS BIGINT) AS words, max(room) AS room FROM joined WHERE size > 0 AND room > 0 GROUP BY source, class
), levels AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
    CAST(sum(words * class) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest FROM classes
), shares AS (
  SELECT source, max(class) AS top, arg_max(factor, class) AS factor, arg_max(certain, class) AS certain FROM (SELECT *, (room - CAST(certain AS DOUBLE)) / rest AS factor FROM levels) WHERE factor * class <= 1 GROUP BY source
), odds AS (
  SELECT j.*, h.top, j.room - CAST(coalesce(h.certain, 0) AS DOUBLE) AS open_room, CASE WHEN size > 0 AND h.top IS NOT NULL THEN CASE WHEN class > h.top THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, h.factor * class) END ELSE 0.0 END AS p
  FROM joined j LEFT JOIN shares h ON j.source IS NOT DISTINCT FROM h.source
), ranked_docs AS (
  SELECT *, CASE WHEN p > 0 AND class <= top THEN (u / (1 - u)) * ((1 - p) / p) END AS rnk FROM odds
), run AS (
  SELECT *, sum(CASE WHEN rnk IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rnk NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM ranked_docs
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN p > 0 AND (class > top OR 2 * upto - size <= 2 * open_room) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM run
"""
