"""As-of reads, latest versions and overlap joins over bitemporal claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimstead.functions.temporal import open_end
from claimstead.functions.text import claim_object
from claimstead.operators import sweep
from claimstead.operators.identity import canonical_claims, settle


def latest(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key by the order columns; partial maxima are taken before the shuffle."""
    rest = [c for c in versions.columns if c != key and c not in order]
    top = versions.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(key, *[F.col(f"_top.{c}").alias(c) for c in [*order, *rest]]).select(*versions.columns)


def known_at_each(versions: DataFrame, instants: list[Column], key: str = "claim_id", order: tuple[str, ...] = ("recorded_at", "version_seq")) -> DataFrame:
    """For each instant and key the last version recorded by then (as-of read for a list of instants).

    A version counts once, from the first instant on that it precedes: a maximum per key and span between instants is combined before the shuffle, and an instant
    takes that of the last span which has one. No join, and no row per version and instant.
    """
    rest = [c for c in versions.columns if c != key and c not in order]
    at = F.array_sort(F.array_distinct(F.array_compact(F.array(*instants))))
    spans = range(len(instants))
    since = F.filter(at, lambda t: t >= F.col(order[0]))
    first = F.size(at) - F.size(since)  # the span of a version, those after the last instant have none
    told = versions.withColumn("_span", F.when(F.size(since) > 0, first))
    top = told.where("_span IS NOT NULL").groupBy(key).agg(*[F.max(F.when(F.col("_span") == i, F.struct(*order, *rest))).alias(f"_{i}") for i in spans])
    held = F.array(*[F.struct(F.get(at, F.lit(i)).alias("known_at"), F.coalesce(*[f"_{j}" for j in range(i, -1, -1)]).alias("top")) for i in spans])
    each = top.select(key, F.explode(F.filter(held, lambda x: x["known_at"].isNotNull() & x["top"].isNotNull())).alias("_h"))
    return each.select("_h.known_at", key, *[F.col(f"_h.top.{c}").alias(c) for c in [*order, *rest]])


def as_of_join(probes: DataFrame, versions: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """Each probe (key, at) with the last version of its key recorded by then, or nulls: probes and versions are laid in one order per key, so the work is linear in both."""
    rest = [c for c in versions.columns if c not in (key, *order)]
    state = F.struct(*order, *rest)
    left = probes.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"), F.lit(None).cast(versions.select(state.alias("s")).schema["s"].dataType).alias("_state"))
    right = versions.select(F.col(key), F.col(order[0]).alias("_at"), F.lit(0).alias("_probe"), F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("r")).schema["r"].dataType).alias("_row"), state.alias("_state"))
    run = Window.partitionBy(key).orderBy("_at", "_probe", F.col("_state").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("_last", F.last("_state", ignorenulls=True).over(run)).where("_probe = 1")
    return seen.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in [*order, *rest]])


def overlap_pairs(claims: DataFrame, per_range: int = sweep.RANGE) -> DataFrame:
    """left_id, right_id, subject_id, predicate: pairs of unretracted claims on one subject and predicate with different objects, entities or literals, and overlapping validity; the lesser id comes first. A plane sweep: no group is joined with itself."""
    group = ["tenant_id", "namespace_id", "subject_id", "predicate"]
    live = claims.where("status <> 'retracted'").select(*group, "claim_id", claim_object(claims).alias("object"), "valid_from", open_end(F.col("valid_to")).alias("valid_end"))
    return sweep.overlap_pairs(live, group, per_range).select("left_id", "right_id", "subject_id", "predicate")


def later_conflicts(claims: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Claims, with status conflicted where an earlier claim on the subject and predicate has another object (validity is open-ended here).

    With roots, subjects and entity objects count by their roots. No group is sorted: of each (subject, predicate) only the first object
    and the first place of another one are needed, which are two minima, combined before the shuffle. A claim with the first object conflicts
    if it comes after that place, any other does. Claims without an object neither conflict nor count.
    """
    counted = claims if roots is None else canonical_claims(claims, roots)
    key = {"_s": F.col("subject_id"), "_p": F.col("predicate")}
    told = counted.select(*[v.alias(k) for k, v in key.items()], claim_object(counted).alias("object"), F.struct("recorded_at", "claim_id").alias("place")).where("object IS NOT NULL")
    firsts = settle(told.groupBy("_s", "_p", "object").agg(F.min("place").alias("place")))
    # scans of their own, so that Spark can split the other side of a join where one subject has very many rows
    first = settle(firsts.groupBy("_s", "_p").agg(F.min(F.struct("place", "object")).alias("f")).select("_s", "_p", F.col("f.object").alias("_object")))
    second = firsts.join(first, ["_s", "_p"]).where("object <> _object").groupBy("_s", "_p").agg(F.min("place").alias("_other"))
    known = settle(first.join(second, ["_s", "_p"], "left"))
    own = claim_object(counted)
    judged = counted.withColumns({**key, "_own": own}).join(known, ["_s", "_p"], "left")
    late = F.when(F.col("_own") != F.col("_object"), True).when(F.col("_own") == F.col("_object"), F.col("_other") < F.struct("recorded_at", "claim_id"))
    marked = judged.select("claim_id", F.coalesce(late, F.lit(False)).alias("_late")) if roots is not None else None
    if marked is None:
        return judged.withColumn("status", F.when(F.coalesce(late, F.lit(False)), "conflicted").otherwise(F.col("status"))).select(*claims.columns)
    return claims.join(marked, "claim_id").withColumn("status", F.when(F.col("_late"), "conflicted").otherwise(F.col("status"))).select(*claims.columns)
