"""Measures of retrieval, latency and agreement between runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimstead.operators.identity import settle, small


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """cases, precision_at_k, recall_at_k, hit_rate_at_k, mrr: macro means over cases; all 0 without cases or with k of 0.

    retrieved: query_id, claim_id, rank from 1 (repeats count again); relevant: query_id, claim_id; cases: query_id.
    """
    if k <= 0:
        zero = [F.lit(0.0).alias(c) for c in ("precision_at_k", "recall_at_k", "hit_rate_at_k", "mrr")]
        return cases.agg(F.count(F.lit(1)).alias("cases")).select("cases", *zero)
    wanted = relevant.select("query_id", "claim_id").distinct()
    hits = retrieved.where(F.col("rank") <= k).join(wanted, ["query_id", "claim_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    each = cases.select("query_id").join(hits, "query_id", "left").join(sizes, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    mean = lambda v: F.coalesce(F.avg(v), F.lit(0.0))
    return each.agg(
        F.count(F.lit(1)).alias("cases"), mean(F.col("hits") / k).alias("precision_at_k"), mean(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))).alias("recall_at_k"),
        mean((F.col("hits") > 0).cast("double")).alias("hit_rate_at_k"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def recall_at_k(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """query_id, recall of an approximate list against the exact one; 1 if nothing was expected."""
    found = actual.select("query_id", "claim_id").withColumn("_hit", F.lit(1.0))
    return expected.join(found, ["query_id", "claim_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))


def percentiles(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95), bins: int = 4096) -> DataFrame:
    """Nearest-rank percentiles and the mean per group, exactly; null values don't count.

    No group is sorted: the range that holds a percentile is cut into bins, counted on all tasks, and narrowed to one bin, twice; in
    what is left equal values are counted and those few counts are ordered.
    """
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])
    held = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    groups = settle(held.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("mean")))
    wanted = groups.select(*by, F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point"), "lo", "hi", "n").withColumn("nth", F.greatest(F.ceil(F.col("n") * F.col("point")), F.lit(1))).drop("n")

    def counted(wanted_: DataFrame, cell) -> DataFrame:
        inside = held.alias("h").join(small(wanted_).alias("w"), same("h", "w") & F.col("_v").between(F.col("lo"), F.col("hi")))
        cells = inside.select(*[F.col(f"w.{c}") for c in by], "point", "nth", "_v", cell.alias("cell"))
        sums = cells.groupBy(*by, "point", "nth", "cell").agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        run = Window.partitionBy(*by, "point").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        return sums.withColumn("upto", F.sum("n").over(run)).where((F.col("upto") >= F.col("nth")) & (F.col("upto") - F.col("n") < F.col("nth")))

    width = F.col("hi") - F.col("lo")
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    for _ in range(2):
        wanted = settle(counted(wanted, bin_).select(*by, "point", "lo", "hi", (F.col("nth") - F.col("upto") + F.col("n")).alias("nth")))
    at = lambda p: F.max(F.when(F.col("point") == p, F.col("lo"))).alias(f"p{int(p * 100)}")
    found = counted(wanted, F.col("_v")).groupBy(*by).agg(*[at(float(p)) for p in points])
    return groups.alias("g").join(found.alias("f"), same("g", "f")).select(*[F.col(f"g.{c}") for c in by], *[f"p{int(p * 100)}" for p in points], "mean")


def histogram(rows: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts up to each bound, the sum and the count."""
    upto = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{b:g}") for b in bounds]
    return rows.groupBy(*by).agg(*upto, F.sum(value).alias("sum"), F.count(value).alias("count"))


def selectivity(rows: DataFrame, eligible: Column) -> DataFrame:
    return rows.agg(F.avg(eligible.cast("double")).alias("selectivity"))


def fallback_rate(log: DataFrame, fallback: Column) -> DataFrame:
    return log.agg(F.avg(F.when(fallback, 1.0).otherwise(0.0)).alias("fallback_rate"))


def parity(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group in two datasets and whether they agree."""
    l_ = left.groupBy(*by).agg(F.count(F.lit(1)).alias("left_count"))
    r = right.groupBy(*by).agg(F.count(F.lit(1)).alias("right_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = l_.join(r, by, "full").select(*by, zero("left_count"), zero("right_count"))
    return both.withColumn("equal", F.col("left_count") == F.col("right_count"))


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either dataset that the other lacks, repeats counted."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).union(right.exceptAll(left).withColumn("only_in", F.lit("right")))
