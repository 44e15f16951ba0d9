"""Canonical entities, merge lineage, review workflow and entity resolution."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstead.functions.text import name_signal, name_tokens, normal_name


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the session names in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it only a session on one machine gets a temporary folder, as other nodes couldn't read one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return tempfile.mkdtemp(prefix="claimstead-")


#: Rows of a side table, and bytes of them as JSON, up to which a broadcast is asked for; beyond it Spark picks the join.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 16_000_000


def small(df: DataFrame) -> DataFrame:
    """Mark a side table for broadcast if it has at most BROADCAST_ROWS rows of BROADCAST_BYTES in all; else leave the join to Spark."""
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def active_redirects(merges: DataFrame) -> DataFrame:
    """absorbed_id, surviving_id: of merges that aren't reverted the last for each absorbed entity."""
    last = merges.where("NOT reverted").groupBy("absorbed_id").agg(F.max(F.struct("event_seq", "surviving_id")).alias("m"))
    return last.select("absorbed_id", F.col("m.surviving_id").alias("surviving_id"))


def roots(merges: DataFrame, on_cycle: str = "error") -> DataFrame:
    """entity_id, canonical_id for absorbed entities, by pointer jumping: each round halves the depth, so log2 of their number and one more settle all chains but those that end in a cycle.

    A chain that ends in a cycle has a final root that still redirects. Such chains raise, or, with on_cycle='stop', end where they
    enter their cycle; entities of the cycle are their own roots.
    """
    redirects = settle(active_redirects(merges).withColumnsRenamed({"absorbed_id": "entity_id", "surviving_id": "to"}))
    if on_cycle == "stop":
        redirects = settle(redirects.join(_on_cycles(redirects), "entity_id", "left_anti"))
    jumps = redirects
    for _ in range(redirects.count().bit_length() + 1):
        next_ = jumps.select(F.col("entity_id").alias("_at"), F.col("to").alias("_further"))
        moved = settle(jumps.join(next_, jumps["to"] == next_["_at"], "left").select("entity_id", F.coalesce("_further", "to").alias("to"), (F.col("_further").isNotNull() & (F.col("_further") != F.col("to"))).alias("moved")))
        changed = not moved.where("moved").isEmpty()
        jumps = moved.drop("moved")
        if not changed:
            break
    cyclic = jumps.join(redirects.select(F.col("entity_id").alias("to")), "to", "left_semi")
    if on_cycle == "error" and not cyclic.isEmpty():
        raise ValueError("entity merges form a cycle")
    return jumps.select("entity_id", F.col("to").alias("canonical_id"))


def _jumped(jumps: DataFrame) -> DataFrame:
    next_ = jumps.select(F.col("entity_id").alias("_at"), F.col("to").alias("_further"))
    return settle(jumps.join(next_, jumps["to"] == next_["_at"], "left").select("entity_id", F.coalesce("_further", "to").alias("to")))


def _on_cycles(redirects: DataFrame) -> DataFrame:
    """entity_id of entities that lie on a cycle. After as many jumps as there are redirects every chain has come to its end or into its cycle, and a cycle's entities have come onto each other; jumps double each round."""
    jumps = redirects
    for _ in range(redirects.count().bit_length()):
        jumps = _jumped(jumps)
    return jumps.select(F.col("to").alias("entity_id")).distinct().join(redirects, "entity_id", "left_semi")


def canonical_claims(claims: DataFrame, roots_: DataFrame) -> DataFrame:
    """Claims with subject_id and, where they have it, object_entity_id replaced by their roots."""
    for column in [c for c in ("subject_id", "object_entity_id") if c in claims.columns]:
        claims = canonical(claims.drop("canonical_id"), column, roots_).drop(column).withColumnRenamed("canonical_id", column)
    return claims


def canonical(entities: DataFrame, id_: str, roots_: DataFrame) -> DataFrame:
    """entities with canonical_id: their root, or themselves."""
    found = roots_.select(F.col("entity_id").alias("_of"), F.col("canonical_id").alias("_root"))
    return entities.join(found, F.col(id_) == F.col("_of"), "left").withColumn("canonical_id", F.coalesce("_root", id_)).drop("_of", "_root")


def merge_lineage(merges: DataFrame, entities: DataFrame, id_: str, name: str) -> DataFrame:
    """Merges with their surviving entity's name and whether they hold."""
    survivors = entities.select(F.col(id_).alias("surviving_id"), F.col(name).alias("surviving_name"))
    return merges.join(survivors, "surviving_id").select("absorbed_id", "surviving_id", "surviving_name", F.when(F.col("reverted"), "reverted").otherwise("merged").alias("state"))


def resolution_state(proposals: DataFrame, reviews: DataFrame, merges: DataFrame) -> DataFrame:
    """proposal_id, state: open, rejected, approved, merged or reverted, by the last review and the merge if there is one."""
    last = reviews.groupBy("proposal_id").agg(F.max(F.struct("decided_seq", "outcome")).alias("r")).select("proposal_id", F.col("r.outcome").alias("outcome"))
    done = merges.select("proposal_id", F.col("reverted").alias("_reverted"))
    state = (
        F.when(F.col("_reverted"), "reverted").when(F.col("_reverted").isNotNull(), "merged").when(F.col("outcome") == "approve", "approved").when(F.col("outcome") == "reject", "rejected").otherwise("open")
    )
    return proposals.join(last, "proposal_id", "left").join(done, "proposal_id", "left").select("proposal_id", state.alias("state"))


def normal_names(entities: DataFrame, id_: str, name: str) -> DataFrame:
    return entities.select(F.col(id_).alias("entity_id"), normal_name(F.col(name)).alias("name")).where("name <> ''")


def candidates(queries: DataFrame, names: DataFrame, limit: int = 5, min_score: float = 0.5, external: DataFrame | None = None, readable: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, entity_id, kind, score, place, signals: the best entities of each query; signals are all that tell for an entity, best first, each once.

    A query may have several names, and own: the root of its own cluster, which is no candidate. external: query_id, canonical_id, value of equal external ids (external_matches).
    readable keeps, of rows with query_id and entity_id, those whose entity the query's reader may read (readable_entities): others neither are nor support a candidate.

    queries: query_id, name; names: entity_id, name, source (label or alias), canonical_id; all names normalised. Distinct names meet, not entities: by
    a token of the rarest half of each, and for substrings by that run of three letters of the shorter name that the fewest longer ones have, or by all of it where it
    has one or two (a query of those looks for no substrings). A root's best signal counts. Queries without own, external ids and readers that have the same names have the same candidates, which are found once for all of them.
    """
    if external is not None or readable is not None or "own" in queries.columns:
        return _candidates(queries, names, limit, min_score, external, readable)
    asked = queries.groupBy("query_id").agg(F.sort_array(F.collect_set("name")).alias("_names"))
    alike = settle(asked.select("_names").distinct().withColumn("_alike", F.monotonically_increasing_id()))
    found = _candidates(alike.select(F.col("_alike").alias("query_id"), F.explode("_names").alias("name")), names, limit, min_score).withColumnRenamed("query_id", "_alike")
    return asked.join(alike, "_names").join(found, "_alike").drop("_names", "_alike")


def _candidates(queries: DataFrame, names: DataFrame, limit: int, min_score: float, external: DataFrame | None = None, readable: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    q = queries.select(F.col("name").alias("q")).distinct()
    c = names.select(F.col("name").alias("c")).distinct()
    # names that share half of their tokens share one among the rarest of each: all but half of its tokens, and one
    often = settle(c.select(F.explode(name_tokens(F.col("c"))).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n")))

    def rare(df: DataFrame, col: str) -> DataFrame:
        spread_ = df.select(col, F.explode(name_tokens(F.col(col))).alias("block")).join(often, "block", "left")
        order = spread_.groupBy(col).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "block"))).alias("t"))
        return order.select(col, F.explode(F.slice("t", F.lit(1), F.size("t") - F.ceil(F.size("t") / 2).cast("int") + 1)).alias("x")).select(col, F.col("x.block").alias("block"))

    grams = lambda col: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - 2, F.lit(1))), lambda i: F.substr(F.col(col), i, F.lit(3))))
    spread = lambda df, col: df.where(F.length(col) >= 3).withColumn("block", F.explode(grams(col)))

    def rarest(short: DataFrame, col: str, long: DataFrame) -> DataFrame:
        """Names with the run of three that the fewest of the longer names have; a name with a run that none has lies in none."""
        held = long.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        met = spread(short, col).join(held, "block").groupBy(col).agg(F.count(F.lit(1)).alias("runs"), F.min(F.struct("n", "block")).alias("r"))
        return met.where(F.col("runs") == F.size(grams(col))).select(col, F.col("r.block").alias("block"))

    cuts = lambda col, n: F.transform(F.sequence(F.lit(1), F.length(col) - (n - 1)), lambda i: F.substr(F.col(col), i, F.lit(n)))
    brief = q.where(F.length("q") >= 3).withColumn("block", F.explode(F.array_distinct(F.concat(cuts("q", 1), cuts("q", 2)))))
    pairs = (
        rare(q, "q").join(rare(c, "c"), "block").select("q", "c")
        .union(rarest(q, "q", spread(c, "c")).join(spread(c, "c"), "block").where(F.contains("c", "q")).select("q", "c"))
        .union(spread(q, "q").join(rarest(c, "c", spread(q, "q")), "block").where(F.contains("q", "c")).select("q", "c"))
        .union(brief.join(c.where(F.length("c") < 3), F.col("block") == F.col("c")).select("q", "c")).distinct()
    )
    pairs = pairs.join(names.select(F.col("name").alias("c"), "source").distinct(), "c")
    scored = pairs.withColumn("signal", name_signal(F.col("q"), F.col("c"), F.col("source"))).where("signal IS NOT NULL").select("q", "c", "source", "signal.*")
    told, external = _told(queries, names, scored, external, limit, min_score) if readable is None else (readable(_hits(queries, names, scored)), external)
    told = told.select("query_id", "canonical_id", "kind", "score", "source", F.col("c").alias("name"))
    if external is not None:
        told = told.unionByName(external.select("query_id", "canonical_id", F.lit("external-id-exact").alias("kind"), F.lit(1.0).alias("score"), F.lit("external-id").alias("source"), F.col("value").alias("name")))
    if "own" in queries.columns:
        told = told.join(queries.select("query_id", F.col("own").alias("canonical_id")).distinct(), ["query_id", "canonical_id"], "left_anti")
    told = settle(told.distinct())
    best = told.groupBy("query_id", "canonical_id").agg(F.max(F.struct("score", "kind")).alias("b")).select("query_id", "canonical_id", "b.kind", "b.score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "canonical_id")
    top = best.where(F.col("score") >= min_score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    # signals are gathered for the few chosen pairs only
    listed = told.withColumnsRenamed({"kind": "k", "score": "s"}).join(top.select("query_id", "canonical_id"), ["query_id", "canonical_id"])
    listed = listed.groupBy("query_id", "canonical_id").agg(F.sort_array(F.collect_set(F.struct((-F.col("s")).alias("s"), F.col("k").alias("kind"), "source", "name"))).alias("g"))
    signals = F.transform("g", lambda x: F.struct(x["kind"].alias("kind"), (-x["s"]).alias("score"), x["source"].alias("source"), x["name"].alias("name")))
    return top.join(listed.select("query_id", "canonical_id", signals.alias("signals")), ["query_id", "canonical_id"]).select("query_id", F.col("canonical_id").alias("entity_id"), "kind", "score", "place", "signals")


def _hits(queries: DataFrame, names: DataFrame, scored: DataFrame) -> DataFrame:
    beside = queries.select("query_id", F.col("name").alias("_name")).join(scored, F.col("_name") == F.col("q")).drop("_name")
    return beside.join(names.withColumnsRenamed({"name": "n", "source": "s"}), (F.col("c") == F.col("n")) & (F.col("source") == F.col("s")))


def _told(queries: DataFrame, names: DataFrame, scored: DataFrame, external: DataFrame | None, limit: int, min_score: float) -> tuple[DataFrame, DataFrame | None]:
    """All signals of the roots that can be among the best of a query, as hits and external matches.

    Of a name only its first roots by id count, as those come before its others in every query that the name is found for; of a name asked only its best roots, and of equal external ids the
    first. One more than the limit, as a query's own root may be among them. So many entities of one name, or many queries for one, don't multiply.
    """
    scored, most = settle(scored), limit + ("own" in queries.columns)
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("canonical_id"))
    held = names.select(F.col("name").alias("c"), "source", "canonical_id").distinct()
    first = held.withColumn("nth", nth("c", "source")).where(F.col("nth") <= most).drop("nth")
    best = scored.where(F.col("score") >= min_score).join(first, ["c", "source"]).groupBy("q", "canonical_id").agg(F.max("score").alias("s"))
    near = best.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "canonical_id"))).where(F.col("nth") <= most).select("q", "canonical_id")
    asked = queries.select("query_id", F.col("name").alias("q")).distinct()
    chosen = asked.join(near, "q").select("query_id", "canonical_id")
    if external is not None:
        same = external.select("query_id", "canonical_id").distinct().withColumn("nth", nth("query_id")).where(F.col("nth") <= most).drop("nth")
        chosen = chosen.unionByName(same)
    chosen = settle(chosen.distinct())
    told = chosen.join(held, "canonical_id").join(asked, "query_id").join(scored, ["q", "c", "source"])
    return told, external if external is None else external.join(chosen, ["query_id", "canonical_id"])


def readable_entities(questions: DataFrame, entities: DataFrame, now: Column) -> Callable[[DataFrame], DataFrame]:
    """For candidates: questions has query_id and reader, entities entity_id and a resource's scope."""
    from claimstead.functions.scope import access_reason

    def keep(hits: DataFrame) -> DataFrame:
        scope = entities.select(F.col("entity_id").alias("_e"), F.struct("tenant_id", "namespace_id", "classification", "visibility", "owner_id").alias("_r"))
        who = questions.select(F.col("query_id").alias("_q"), F.col("reader").alias("_p")).distinct()
        beside = hits.join(scope, F.col("entity_id") == F.col("_e")).join(who, F.col("query_id") == F.col("_q"))
        given = F.struct(F.col("_p.tenant_id").alias("tenant_id"), now.alias("now"), F.lit("entity-resolution").alias("purpose"), F.lit(None).cast("struct<delegator_id: string, scope: array<string>, expires_at: timestamp_ntz, purpose: string>").alias("delegation"))
        return beside.where(access_reason(F.col("_p"), F.lit("knowledge.read"), F.col("_r"), given) == "ALLOW").drop("_e", "_r", "_q", "_p")

    return keep


def external_matches(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entity_id, score (1) for equal normalised (system, value) pairs, and canonical_id and the value where entities have a canonical_id."""
    also = ["canonical_id", "value"] if "canonical_id" in entities.columns else []
    return queries.join(entities, ["system", "value"]).select("query_id", "entity_id", F.lit(1.0).alias("score"), *also).distinct()
