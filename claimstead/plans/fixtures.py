"""Claims, versions, edges, merges, decisions and events, derived from the tables; each as a frame and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.functions.scope import CLASSIFICATIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str, prefix: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    levels = {"1-URGENT": "tlp:red", "2-HIGH": "tlp:amber", "3-MEDIUM": "confidential", "4-NOT SPECIFIED": "internal"}
    level = F.lit("public")
    for priority, name in levels.items():
        level = F.when(F.col("o_orderpriority") == priority, name).otherwise(level)
    key = F.col("o_orderkey")
    return joined.select(
        text_of("o_orderkey", "o-").alias("claim_id"), text_of("n_regionkey", "t-").alias("tenant_id"), text_of("c_nationkey", "ns-").alias("namespace_id"),
        text_of("o_custkey", "customer:").alias("subject_id"), F.when(key % 2 == 0, "order_status").otherwise("orderStatus").alias("predicate"),
        F.col("o_orderstatus").alias("object_value"), level.alias("classification"),
        F.when(key % 5 == 0, "private").when(key % 5 == 1, "public").otherwise("workspace").alias("visibility"), text_of("o_custkey", "customer:").alias("owner_id"),
        F.col("o_orderdate").alias("valid_from"), F.when(key % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL '90' DAY")).alias("valid_to"), F.col("o_orderdate").alias("recorded_at"),
        F.when(key % 11 == 0, "retracted").otherwise("asserted").alias("status"), (key % 101 / 100).alias("confidence"),
    )


CLAIMS = """
f_claims AS (
  SELECT concat('o-', CAST(o.o_orderkey AS VARCHAR)) AS claim_id, concat('t-', CAST(n.n_regionkey AS VARCHAR)) AS tenant_id, concat('ns-', CAST(c.c_nationkey AS VARCHAR)) AS namespace_id,
    concat('customer:', CAST(o.o_custkey AS VARCHAR)) AS subject_id, CASE WHEN o.o_orderkey % 2 = 0 THEN 'order_status' ELSE 'orderStatus' END AS predicate, o.o_orderstatus AS object_value,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'tlp:red' WHEN '2-HIGH' THEN 'tlp:amber' WHEN '3-MEDIUM' THEN 'confidential' WHEN '4-NOT SPECIFIED' THEN 'internal' ELSE 'public' END AS classification,
    CASE o.o_orderkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'public' ELSE 'workspace' END AS visibility, concat('customer:', CAST(o.o_custkey AS VARCHAR)) AS owner_id,
    o.o_orderdate AS valid_from, CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '90' DAY END AS valid_to, o.o_orderdate AS recorded_at,
    CASE WHEN o.o_orderkey % 11 = 0 THEN 'retracted' ELSE 'asserted' END AS status, CAST(o.o_orderkey % 101 AS DOUBLE) / 100 AS confidence
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def claim_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "retracted").when(F.col("l_returnflag") == "A", "conflicted").otherwise("asserted")
    return table(spark, sf_dir, "lineitem").select(text_of("l_orderkey", "o-").alias("claim_id"), F.col("l_linenumber").alias("version_seq"), F.col("l_shipdate").alias("recorded_at"), status.alias("status"), F.col("l_partkey").alias("object_value"))


VERSIONS = """
f_claim_versions AS (
  SELECT concat('o-', CAST(l_orderkey AS VARCHAR)) AS claim_id, l_linenumber AS version_seq, l_shipdate AS recorded_at,
    CASE l_returnflag WHEN 'R' THEN 'retracted' WHEN 'A' THEN 'conflicted' ELSE 'asserted' END AS status, l_partkey AS object_value FROM lineitem
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l_, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    contains = l_.select(F.concat(text_of("l_orderkey", "l-"), text_of("l_linenumber", "-")).alias("claim_id"), text_of("l_orderkey", "order:").alias("subject_id"), text_of("l_partkey", "part:").alias("object_entity_id"))
    placed = o.select(text_of("o_orderkey", "p-").alias("claim_id"), text_of("o_orderkey", "order:").alias("subject_id"), text_of("o_custkey", "customer:").alias("object_entity_id"))
    return contains.unionByName(placed)


EDGES = """
f_edges AS (
  SELECT concat('l-', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS claim_id, concat('order:', CAST(l_orderkey AS VARCHAR)) AS subject_id, concat('part:', CAST(l_partkey AS VARCHAR)) AS object_entity_id FROM lineitem
  UNION ALL
  SELECT concat('p-', CAST(o_orderkey AS VARCHAR)), concat('order:', CAST(o_orderkey AS VARCHAR)), concat('customer:', CAST(o_custkey AS VARCHAR)) FROM orders
)"""


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge rows: absorbed entity, surviving entity, whether reverted, and the order of the events."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0 AND c_custkey >= 5")
    return c.select(F.col("c_custkey").alias("absorbed_id"), F.floor(F.col("c_custkey") / 5).cast("long").alias("surviving_id"), (F.col("c_custkey") % 35 == 0).alias("reverted"), F.col("c_custkey").alias("event_seq"))


MERGES = """
f_merges AS (
  SELECT c_custkey AS absorbed_id, CAST(floor(c_custkey / 5) AS BIGINT) AS surviving_id, c_custkey % 35 = 0 AS reverted, c_custkey AS event_seq FROM customer WHERE c_custkey % 5 = 0 AND c_custkey >= 5
)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("actor"), F.col("o_orderstatus").alias("selected_outcome"), F.col("o_orderpriority").alias("purpose"),
        (F.col("o_orderkey") % 101 / 100).alias("confidence"), F.col("o_orderdate").alias("recorded_at"), F.concat(F.lit("ns-"), (F.col("o_custkey") % 25).cast("string")).alias("namespace_id"),
        F.get(F.lit(CLASSIFICATIONS), (F.floor(F.col("o_orderkey") / 3) % 5).cast("int")).alias("classification"),
    )


DECISIONS = """
f_decisions AS (
  SELECT o_orderkey AS decision_id, o_custkey AS actor, o_orderstatus AS selected_outcome, o_orderpriority AS purpose, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence, o_orderdate AS recorded_at,
    concat('ns-', CAST(o_custkey % 25 AS VARCHAR)) AS namespace_id, ['public', 'internal', 'confidential', 'tlp:amber', 'tlp:red'][1 + o_orderkey // 3 % 5] AS classification FROM orders
)"""


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy version for each part: a window of days, lists of purposes, namespaces and classifications, and rules, each of which some haven't."""
    k = F.col("p_partkey")
    pick = lambda values, v: F.get(F.lit(values), F.pmod(v, F.lit(len(values))).cast("int"))
    space = lambda v: F.concat(F.lit("ns-"), (v % 25).cast("string"))
    since = F.lit("1992-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((k * 37 % 2400).cast("int"), F.lit(12))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p-"), (k % 40).cast("string")).alias("policy_id"), k.alias("version"), F.when(k % 9 == 0, "draft").otherwise("active").alias("status"),
        F.when(k % 310 != 0, since).alias("effective_from"), F.when(k % 600 != 0, since + F.make_dt_interval(F.ceil(F.col("p_size") / 3).cast("int"))).alias("effective_to"),
        F.when(k % 4 != 0, F.array(pick(PURPOSES, k))).alias("purposes"), F.when(k % 50 != 0, F.array(space(k), space(k + 7))).alias("namespace_ids"),
        F.when(k % 3 != 0, F.array(pick(CLASSIFICATIONS, k), pick(CLASSIFICATIONS, k + 2))).alias("classifications"), F.when(k % 4 != 0, (k % 4) / 4).alias("min_confidence"),
        F.when(k % 3 == 1, F.array(F.lit("F"), F.lit("O"))).when(k % 3 == 2, F.array(F.lit("O"))).alias("allowed_outcomes"), F.when(k % 2 == 0, pick(CLASSIFICATIONS, F.floor(k / 2))).alias("max_classification"),
    )


PURPOSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LEVELS = "['public', 'internal', 'confidential', 'tlp:amber', 'tlp:red']"

POLICIES = f"""
f_policies AS (
  SELECT concat('p-', CAST(p_partkey % 40 AS VARCHAR)) AS policy_id, p_partkey AS version, CASE WHEN p_partkey % 9 = 0 THEN 'draft' ELSE 'active' END AS status,
    CASE WHEN p_partkey % 310 <> 0 THEN since END AS effective_from, CASE WHEN p_partkey % 600 <> 0 THEN since + to_days(CAST(ceil(p_size / 3) AS INTEGER)) END AS effective_to,
    CASE WHEN p_partkey % 4 <> 0 THEN [['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + p_partkey % 5]] END AS purposes,
    CASE WHEN p_partkey % 50 <> 0 THEN [concat('ns-', CAST(p_partkey % 25 AS VARCHAR)), concat('ns-', CAST((p_partkey + 7) % 25 AS VARCHAR))] END AS namespace_ids,
    CASE WHEN p_partkey % 3 <> 0 THEN [{_LEVELS}[1 + p_partkey % 5], {_LEVELS}[1 + (p_partkey + 2) % 5]] END AS classifications, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 4 / 4.0::DOUBLE END AS min_confidence,
    CASE p_partkey % 3 WHEN 1 THEN ['F', 'O'] WHEN 2 THEN ['O'] END AS allowed_outcomes, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 % 5 END AS max_level
  FROM (SELECT *, TIMESTAMP '1992-01-01 12:00:00' + to_days(CAST(p_partkey * 37 % 2400 AS INTEGER)) AS since FROM part)
)"""


def decision_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), F.col("l_partkey").alias("claim_id")).distinct()


DECISION_CLAIMS = """
f_decision_claims AS (SELECT DISTINCT l_orderkey AS decision_id, l_partkey AS claim_id FROM lineitem)"""


def event_log(events: DataFrame) -> DataFrame:
    """Domain events from the events table, batch or stream."""
    kinds = {"signup": "claim.asserted", "error": "claim.retracted", "purchase": "decision.recorded", "view": "context.accessed"}
    kind = F.lit("policy.evaluated")
    for name, value in kinds.items():
        kind = F.when(F.col("event_type") == name, value).otherwise(kind)
    return events.select("event_id", F.col("ts").alias("occurred_at"), F.col("user_id").alias("claim_id"), kind.alias("kind"), "value")


EVENTS = """
f_events AS (
  SELECT event_id, ts AS occurred_at, user_id AS claim_id, CASE event_type WHEN 'signup' THEN 'claim.asserted' WHEN 'error' THEN 'claim.retracted' WHEN 'purchase' THEN 'decision.recorded' WHEN 'view' THEN 'context.accessed' ELSE 'policy.evaluated' END AS kind, value FROM events
)"""


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "observation").when(F.col("role") == "assistant", "note").otherwise("thread")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("user-"), (F.col("conv_id") % 7).cast("string")).alias("owner_id"), kind.alias("kind"), F.col("text").alias("body"))


MEMORY = """
f_memory AS (
  SELECT conv_id, turn, concat('user-', CAST(conv_id % 7 AS VARCHAR)) AS owner_id, CASE role WHEN 'user' THEN 'observation' WHEN 'assistant' THEN 'note' ELSE 'thread' END AS kind, text AS body FROM conversations
)"""


def merge_log(events: DataFrame) -> DataFrame:
    """The event log with merges and reverts of entities e:2 to e:59 into those of half their number, told by some policy events."""
    log, m = event_log(events), F.floor(F.col("event_id") / 40).cast("long")
    place = F.when(F.col("kind") == "policy.evaluated", F.col("event_id") % 40)
    k = 2 + m % 58
    kind = F.when(place == 0, "entity.merged").when(place == 20, "entity.merge_reverted").otherwise(F.col("kind"))
    entity = lambda v: F.when(place.isin(0, 20), F.concat(F.lit("e:"), v.cast("string")))
    return log.select("event_id", "occurred_at", "claim_id", kind.alias("kind"), entity(k).alias("absorbed_id"), entity(F.floor(k / 2)).alias("surviving_id"))


def projected_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    entity = lambda n: F.concat(F.lit("e:"), (k % n).cast("string"))
    return table(spark, sf_dir, "customer").select(
        k.alias("claim_id"), entity(60).alias("subject_id"), F.lit("segment").alias("predicate"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("object_value"),
        F.when(k % 3 == 0, entity(45)).alias("object_entity_id"), F.when(k % 11 == 0, "retracted").otherwise("asserted").alias("status"),
    )


PROJECTED = """
f_merge_log AS (
  SELECT *, 2 + (event_id // 40) % 58 AS k, CASE WHEN kind = 'policy.evaluated' AND event_id % 40 = 0 THEN 'entity.merged' WHEN kind = 'policy.evaluated' AND event_id % 40 = 20 THEN 'entity.merge_reverted' ELSE kind END AS kind2 FROM f_events
), holds AS (
  SELECT k FROM (SELECT k, arg_max(kind2, (occurred_at, event_id)) AS last FROM f_merge_log WHERE kind2 IN ('entity.merged', 'entity.merge_reverted') GROUP BY k) WHERE last = 'entity.merged'
), walk AS (
  SELECT n AS entity, n AS spot, 0 AS depth FROM range(0, 60) r(n) UNION ALL SELECT w.entity, w.spot // 2, depth + 1 FROM walk w JOIN holds ON k = w.spot
), root AS (
  SELECT entity, arg_max(spot, depth) AS root FROM walk GROUP BY entity
), f_projected AS (
  SELECT c_custkey AS claim_id, r.root AS s, o.root AS o, concat('segment ', CASE WHEN c_custkey % 3 = 0 THEN concat('e:', c_custkey % 45) ELSE c_mktsegment END) AS text
  FROM customer JOIN root r ON r.entity = c_custkey % 60 JOIN root o ON o.entity = c_custkey % 45
  WHERE c_custkey % 11 <> 0 AND c_custkey IN (SELECT claim_id FROM f_events WHERE kind IN ('claim.asserted', 'claim.retracted'))
)"""
