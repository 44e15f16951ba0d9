"""Registered queries over the tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.functions import text as T
from claimstead.functions.scope import CLASSIFICATIONS
from claimstead.functions.temporal import stamp, visible_at
from claimstead.operators import access, conflicts, contracts, decisions, evaluate, extension, extract, fusion, graph, identity, lexical_index, lifecycle, listing, memory, perspective, policy, records, search, temporal, validation, vector_graph, write_access
from claimstead.plans import fixtures as fx
from claimstead.plans import retrieval
from claimstead.sources import sinks
from claimstead.streaming import projection

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Claims in time

VALID, KNOWN = "2000-06-01 00:00:00", "2003-01-01 00:00:00"


@query(f"""WITH {fx.CLAIMS} SELECT claim_id, tenant_id, subject_id FROM f_claims
WHERE status <> 'retracted' AND valid_from <= TIMESTAMP '{VALID}' AND (valid_to IS NULL OR TIMESTAMP '{VALID}' < valid_to) AND recorded_at <= TIMESTAMP '{KNOWN}'""")
def claims_visible_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.claims(spark, sf_dir)
    seen = visible_at(F.col("status"), F.col("valid_from"), F.col("valid_to"), F.col("recorded_at"), stamp(VALID), stamp(KNOWN))
    return c.where(seen).select("claim_id", "tenant_id", "subject_id")


PROBES = ["1996-01-01", "1998-01-01", "2000-01-01", "2002-01-01", "2004-01-01"]


@query(f"""WITH {fx.VERSIONS}, probes AS (SELECT unnest([{', '.join(f"TIMESTAMP '{p} 00:00:00'" for p in PROBES)}]) AS known_at)
SELECT CAST(known_at AS VARCHAR) AS known_at, claim_id, version_seq, status, object_value FROM (
  SELECT *, row_number() OVER (PARTITION BY known_at, claim_id ORDER BY recorded_at DESC, version_seq DESC, status DESC, object_value DESC) AS n FROM probes JOIN f_claim_versions ON recorded_at <= known_at
) WHERE n = 1""")
def claims_known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.known_at_each(fx.claim_versions(spark, sf_dir), [stamp(f"{p} 00:00:00") for p in PROBES])
    return found.select(F.date_format("known_at", "yyyy-MM-dd HH:mm:ss").alias("known_at"), "claim_id", "version_seq", "status", "object_value")


@query(f"""WITH {fx.VERSIONS} SELECT claim_id, version_seq, status, object_value FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY recorded_at DESC, version_seq DESC, status DESC, object_value DESC) AS n FROM f_claim_versions) WHERE n = 1""")
def claims_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest(fx.claim_versions(spark, sf_dir), "claim_id", ["recorded_at", "version_seq"]).select("claim_id", "version_seq", "status", "object_value")


@query(f"""WITH {fx.VERSIONS}, probes AS (SELECT o_orderkey AS decision_id, concat('o-', CAST(o_orderkey AS VARCHAR)) AS claim_id, o_orderdate + INTERVAL '60' DAY AS at FROM orders)
SELECT decision_id, claim_id, version_seq, status, object_value FROM (
  SELECT p.decision_id, p.claim_id, v.version_seq, v.status, v.object_value, row_number() OVER (PARTITION BY p.decision_id ORDER BY v.recorded_at DESC NULLS LAST, v.version_seq DESC, v.status DESC, v.object_value DESC) AS n
  FROM probes p LEFT JOIN f_claim_versions v ON v.claim_id = p.claim_id AND v.recorded_at <= p.at) WHERE n = 1""")
def claims_as_of_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    probes = o.select(F.col("o_orderkey").alias("decision_id"), fx.text_of("o_orderkey", "o-").alias("claim_id"), (F.col("o_orderdate") + F.expr("INTERVAL '60' DAY")).alias("at"))
    versions = fx.claim_versions(spark, sf_dir)
    return temporal.as_of_join(probes, versions, "claim_id", "at", ["recorded_at", "version_seq"]).select("decision_id", "claim_id", "version_seq", "status", "object_value")


@query(f"""WITH {fx.CLAIMS}, live AS (SELECT * FROM f_claims WHERE status <> 'retracted')
SELECT a.claim_id AS left_id, b.claim_id AS right_id, a.subject_id, a.predicate FROM live a JOIN live b
ON a.tenant_id = b.tenant_id AND a.namespace_id = b.namespace_id AND a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id AND a.object_value IS DISTINCT FROM b.object_value
AND a.valid_from < coalesce(b.valid_to, TIMESTAMP '9999-12-31 23:59:59.999') AND b.valid_from < coalesce(a.valid_to, TIMESTAMP '9999-12-31 23:59:59.999')""")
def claim_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.overlap_pairs(fx.claims(spark, sf_dir))


@query(f"""WITH {fx.CLAIMS} SELECT a.claim_id, CASE WHEN EXISTS (SELECT 1 FROM f_claims b WHERE b.subject_id = a.subject_id AND b.predicate = a.predicate AND b.object_value <> a.object_value
  AND (b.recorded_at < a.recorded_at OR (b.recorded_at = a.recorded_at AND b.claim_id < a.claim_id))) THEN 'conflicted' ELSE a.status END AS status FROM f_claims a""")
def later_conflict_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.later_conflicts(fx.claims(spark, sf_dir)).select("claim_id", "status")


# Access

NOW = "2024-01-01 00:00:00"
NAMESPACES = [f"ns-{i}" for i in range(0, 25, 2)]


def readers() -> list:
    return [
        access.reader("customer:10", "t-1", NAMESPACES, "public", ["viewer"]),
        access.reader("customer:20", "t-1", NAMESPACES, "confidential", ["editor"]),
        access.reader("admin-1", "t-2", [f"ns-{i}" for i in range(25)], "tlp:red", ["admin"]),
        access.reader("agent-1", "t-1", [f"ns-{i}" for i in range(25)], "tlp:amber", ["editor"], "agent", "customer:10"),
    ]


def given():
    return access.delegation("customer:10", ["knowledge.read"], "2025-01-01 00:00:00", None)


_READERS = """
readers AS (
  SELECT * FROM (VALUES ('customer:10', 't-1', 0, 0, 'customer:10'), ('customer:20', 't-1', 2, 0, 'customer:20'), ('admin-1', 't-2', 4, 1, 'admin-1'), ('agent-1', 't-1', 3, 1, 'customer:10')) AS r(principal_id, tenant, clearance, all_ns, acting_as)
), decided AS (
  SELECT c.*, r.principal_id, CASE WHEN r.tenant <> c.tenant_id THEN 'CROSS_TENANT_DENIED'
    WHEN r.clearance < CASE c.classification WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'tlp:amber' THEN 3 ELSE 4 END THEN 'CLASSIFICATION_DENIED'
    WHEN c.visibility = 'private' AND c.owner_id <> r.acting_as THEN 'VISIBILITY_DENIED'
    WHEN r.all_ns = 0 AND CAST(substr(c.namespace_id, 4) AS INTEGER) % 2 = 1 THEN 'NAMESPACE_DENIED' ELSE 'ALLOW' END AS reason
  FROM f_claims c CROSS JOIN readers r
)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.reasons(fx.claims(spark, sf_dir), readers(), "knowledge.read", stamp(NOW), given=given())


@query(f"WITH {fx.CLAIMS}, {_READERS} SELECT claim_id, principal_id, reason FROM decided")
def acl_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("claim_id", "principal_id", "reason")


@query(f"WITH {fx.CLAIMS}, {_READERS} SELECT principal_id, classification, count(*) AS omitted FROM decided WHERE reason <> 'ALLOW' GROUP BY ALL")
def acl_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.omissions(_decided(spark, sf_dir))


@query(f"""WITH {fx.CLAIMS}, {_READERS} SELECT principal_id, 'knowledge.read' AS action, 'claim' AS resource_kind, claim_id AS resource_id, CASE WHEN reason = 'ALLOW' THEN 'allow' ELSE 'deny' END AS effect, reason FROM decided""")
def acl_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.receipts(_decided(spark, sf_dir), "knowledge.read", "claim", "claim_id", stamp(NOW)).drop("evaluated_at")


@query(f"""WITH {fx.CLAIMS} SELECT subject_id, ['public', 'internal', 'confidential', 'tlp:amber', 'tlp:red'][1 + max(CASE classification WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'tlp:amber' THEN 3 ELSE 4 END)] AS classification,
['public', 'workspace', 'private'][1 + max(CASE visibility WHEN 'public' THEN 0 WHEN 'workspace' THEN 1 ELSE 2 END)] AS visibility FROM f_claims GROUP BY subject_id""")
def strictest_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.strictest_scope(fx.claims(spark, sf_dir), ["subject_id"])


@query(f"""WITH {fx.CLAIMS}, raw AS (
  SELECT claim_id, CASE WHEN confidence > 0.95 THEN confidence + 1 ELSE confidence END AS confidence, valid_from, CASE WHEN confidence < 0.05 THEN valid_from ELSE valid_to END AS valid_to,
    CASE WHEN visibility = 'private' THEN 0 ELSE 1 END AS n_evidence, CASE WHEN object_value = 'P' THEN ' ' ELSE 'crm' END AS source, classification = 'tlp:red' AS undated FROM f_claims
), coded AS (
  SELECT claim_id, list_filter([CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'CONFIDENCE_RANGE' END, CASE WHEN valid_to <= valid_from THEN 'INVALID_INTERVAL' END, CASE WHEN n_evidence < 1 THEN 'EVIDENCE_REQUIRED' END, CASE WHEN trim(source) = '' OR undated THEN 'PROVENANCE_REQUIRED' END], lambda x: x IS NOT NULL) AS e FROM raw
) SELECT claim_id, array_to_string(e, ',') AS errors FROM coded WHERE len(e) > 0""")
def validation_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.claims(spark, sf_dir).withColumns({
        "confidence": F.when(F.col("confidence") > 0.95, F.col("confidence") + 1).otherwise(F.col("confidence")), "valid_to": F.when(F.col("confidence") < 0.05, F.col("valid_from")).otherwise(F.col("valid_to")),
        "evidence_ids": F.when(F.col("visibility") == "private", F.array().cast("array<string>")).otherwise(F.array("claim_id")),
        "provenance": F.struct(F.when(F.col("object_value") == "P", " ").otherwise("crm").alias("source"), F.lit("loader").alias("actor"), F.lit("import").alias("process"), F.when(F.col("classification") == "tlp:red", "soon").otherwise("2024-01-01T00:00:00Z").alias("timestamp")),
    })
    errors = validation.claim_errors(*[F.col(c) for c in ("claim_id", "confidence", "valid_from", "valid_to", "evidence_ids", "provenance")])
    return validation.split(raw, errors)[1].select("claim_id", F.array_join("errors", ",").alias("errors"))


# Identity

@query(f"""WITH RECURSIVE {fx.MERGES.strip()}, walk AS (
  SELECT c_custkey AS entity_id, c_custkey AS spot, 0 AS depth FROM customer
  UNION ALL SELECT w.entity_id, m.surviving_id, depth + 1 FROM walk w JOIN f_merges m ON m.absorbed_id = w.spot AND NOT m.reverted
) SELECT entity_id, arg_max(spot, depth) AS canonical_id FROM walk GROUP BY entity_id""")
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identity.roots(fx.merges(spark, sf_dir))
    return identity.canonical(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")), "entity_id", found)


@query(f"""WITH {fx.MERGES} SELECT m.absorbed_id, m.surviving_id, c.c_name AS surviving_name, CASE WHEN m.reverted THEN 'reverted' ELSE 'merged' END AS state FROM f_merges m JOIN customer c ON c.c_custkey = m.surviving_id""")
def merge_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.merge_lineage(fx.merges(spark, sf_dir), fx.table(spark, sf_dir, "customer"), "c_custkey", "c_name")


@query("""WITH p AS (SELECT c_custkey AS proposal_id FROM customer WHERE c_custkey % 5 = 0),
r AS (SELECT c_custkey AS proposal_id, 1 AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'approve' ELSE 'reject' END AS outcome FROM customer WHERE c_custkey % 10 < 7 AND c_custkey % 15 <> 0
  UNION ALL SELECT c_custkey, 2, 'approve' FROM customer WHERE c_custkey % 25 = 0),
l AS (SELECT proposal_id, arg_max(outcome, seq) AS outcome FROM r GROUP BY proposal_id), m AS (SELECT c_custkey AS proposal_id, c_custkey % 35 = 0 AS reverted FROM customer WHERE c_custkey % 25 = 0)
SELECT p.proposal_id, CASE WHEN m.reverted THEN 'reverted' WHEN m.reverted IS NOT NULL THEN 'merged' WHEN l.outcome = 'approve' THEN 'approved' WHEN l.outcome = 'reject' THEN 'rejected' ELSE 'open' END AS state
FROM p LEFT JOIN l USING (proposal_id) LEFT JOIN m USING (proposal_id)""")
def resolution_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("proposal_id"))
    k = F.col("proposal_id")
    reviews = c.where((k % 10 < 7) & (k % 15 != 0)).select("proposal_id", F.lit(1).alias("decided_seq"), F.when(k % 2 == 0, "approve").otherwise("reject").alias("outcome"))
    reviews = reviews.union(c.where(k % 25 == 0).select("proposal_id", F.lit(2), F.lit("approve")))
    return identity.resolution_state(c.where(k % 5 == 0), reviews, c.where(k % 25 == 0).withColumn("reverted", k % 35 == 0))


_NORMAL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, {_NORMAL.format('p_name')} AS q FROM part),
n AS (SELECT p_partkey AS entity_id, {_NORMAL.format('p_name')} AS c, 'label' AS source FROM part UNION ALL SELECT p_partkey, {_NORMAL.format("concat(p_name, ' ', p_brand)")}, 'alias' FROM part),
dq AS (SELECT DISTINCT q FROM q), dn AS (SELECT DISTINCT c, source FROM n),
s AS (SELECT q, c, source, len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(c, ' ')))) AS i, len(list_distinct(list_concat(string_split(q, ' '), string_split(c, ' ')))) AS u FROM dq CROSS JOIN dn),
k AS (SELECT q, c, source, CASE WHEN q = c AND source = 'label' THEN 1.0 WHEN q = c THEN 0.92 WHEN i / u >= 0.8 THEN 0.82 WHEN i / u >= 0.5 THEN 0.68 WHEN length(q) >= 3 AND (contains(c, q) OR contains(q, c)) THEN 0.58 END AS score,
  CASE WHEN q = c AND source = 'label' THEN 'label-exact' WHEN q = c THEN 'alias-exact' WHEN i / u >= 0.8 THEN 'strong-token-overlap' WHEN i / u >= 0.5 THEN 'partial-token-overlap' ELSE 'substring' END AS kind FROM s),
b AS (SELECT query_id, entity_id, max(CAST(score AS DOUBLE)) AS score, arg_max(kind, score) AS kind FROM q JOIN k USING (q) JOIN n USING (c, source) WHERE score IS NOT NULL GROUP BY ALL)
SELECT query_id, entity_id, kind, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS place FROM b WHERE score >= 0.5) WHERE place <= 5""")
def er_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part")
    own = identity.normal_names(p, "p_partkey", "p_name")
    alias = identity.normal_names(p.withColumn("full", F.concat_ws(" ", "p_name", "p_brand")), "p_partkey", "full")
    names = own.withColumn("source", F.lit("label")).union(alias.withColumn("source", F.lit("alias"))).withColumn("canonical_id", F.col("entity_id"))
    return identity.candidates(own.withColumnRenamed("entity_id", "query_id"), names).drop("signals")


_ER_OWN = f"""WITH n AS (SELECT p_partkey // 3 AS root, {_NORMAL.format('p_name')} AS c, 'label' AS source FROM part UNION ALL SELECT p_partkey // 3, {_NORMAL.format("concat(p_name, ' ', p_brand)")}, 'alias' FROM part),
q AS (SELECT DISTINCT p_partkey AS query_id, p_partkey // 3 AS own, unnest([{_NORMAL.format('p_name')}, {_NORMAL.format("concat(p_name, ' ', p_brand)")}]) AS q FROM part WHERE p_partkey % 100 = 0),
dq AS (SELECT DISTINCT q FROM q), dn AS (SELECT DISTINCT c, source FROM n),
s AS (SELECT q, c, source, len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(c, ' ')))) AS i, len(list_distinct(list_concat(string_split(q, ' '), string_split(c, ' ')))) AS u FROM dq CROSS JOIN dn),
k AS (SELECT q, c, source, CASE WHEN q = c AND source = 'label' THEN 1.0 WHEN q = c THEN 0.92 WHEN i / u >= 0.8 THEN 0.82 WHEN i / u >= 0.5 THEN 0.68 WHEN length(q) >= 3 AND (contains(c, q) OR contains(q, c)) THEN 0.58 END AS score,
  CASE WHEN q = c AND source = 'label' THEN 'label-exact' WHEN q = c THEN 'alias-exact' WHEN i / u >= 0.8 THEN 'strong-token-overlap' WHEN i / u >= 0.5 THEN 'partial-token-overlap' ELSE 'substring' END AS kind FROM s),
told AS (SELECT DISTINCT query_id, root, kind, CAST(score AS DOUBLE) AS score, source, c FROM q JOIN k USING (q) JOIN n USING (c, source) WHERE score IS NOT NULL AND root <> own
  UNION SELECT a.p_partkey, b.p_partkey // 3, 'external-id-exact', 1.0, 'external-id', concat(a.p_brand, '-', CAST(a.p_size AS VARCHAR)) FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE a.p_partkey % 100 = 0 AND a.p_partkey // 3 <> b.p_partkey // 3),
b AS (SELECT query_id, root AS entity_id, max(score) AS score, max(kind) FILTER (score = top) AS kind, count(*) AS n_signals FROM (SELECT *, max(score) OVER (PARTITION BY query_id, root) AS top FROM told) GROUP BY ALL)
SELECT query_id, entity_id, kind, score, place, n_signals FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS INTEGER) AS place FROM b WHERE score >= 0.5) WHERE place <= 5"""


@query(_ER_OWN)
def er_candidates_for_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of existing parts by all their names and an external id, without their own cluster of three."""
    p = fx.table(spark, sf_dir, "part").withColumn("full", F.concat_ws(" ", "p_name", "p_brand"))
    root = F.floor(F.col("entity_id") / 3).cast("long")
    names = identity.normal_names(p, "p_partkey", "p_name").withColumn("source", F.lit("label")).union(identity.normal_names(p, "p_partkey", "full").withColumn("source", F.lit("alias")))
    names = names.withColumn("canonical_id", root)
    asked = names.where("entity_id % 100 = 0").select(F.col("entity_id").alias("query_id"), "name", F.col("canonical_id").alias("own")).distinct()
    ids = p.select(F.col("p_partkey").alias("entity_id"), F.lit("sku").alias("system"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("value")).withColumn("canonical_id", root)
    same = identity.external_matches(ids.where("entity_id % 100 = 0").select(F.col("entity_id").alias("query_id"), "system", "value"), ids)
    return identity.candidates(asked, names, external=same).select("query_id", "entity_id", "kind", "score", "place", F.size("signals").cast("long").alias("n_signals"))


# Conflicts

RULES = "SELECT 'order_status' AS rule_id, array('order_status', 'orderStatus') AS terms, 1 AS max"

_SETS = f"""WITH {fx.CLAIMS}, live AS (SELECT tenant_id, namespace_id, subject_id, claim_id, object_value, valid_from, coalesce(valid_to, TIMESTAMP '9999-12-31 23:59:59.999') AS valid_end FROM f_claims WHERE status <> 'retracted'),
starts AS (SELECT DISTINCT tenant_id, namespace_id, subject_id, valid_from AS t0 FROM live),
kept AS (SELECT s.tenant_id, s.namespace_id, s.subject_id, s.t0, l.object_value, min(l.claim_id) AS claim_id FROM starts s JOIN live l USING (tenant_id, namespace_id, subject_id) WHERE l.valid_from <= s.t0 AND s.t0 < l.valid_end GROUP BY ALL),
sets AS (SELECT DISTINCT tenant_id, namespace_id, subject_id, ids FROM (SELECT tenant_id, namespace_id, subject_id, t0, list_sort(list(claim_id)) AS ids FROM kept GROUP BY ALL) WHERE len(ids) > 1),
found AS (SELECT * FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE a.tenant_id = b.tenant_id AND a.namespace_id = b.namespace_id AND a.subject_id = b.subject_id AND len(b.ids) > len(a.ids) AND list_has_all(b.ids, a.ids)))"""


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.detect(fx.claims(spark, sf_dir), spark.sql(RULES))


@query(_SETS + " SELECT subject_id, 'order_status' AS rule_id, array_to_string(ids, ',') AS claim_ids FROM found")
def cardinality_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir).select("subject_id", "rule_id", F.array_join("claim_ids", ",").alias("claim_ids"))


@query(_SETS + """, m AS (SELECT subject_id, ids, unnest(ids) AS claim_id FROM found)
SELECT sha256(concat('cardinality', chr(1), array_to_string(m.ids, chr(0)))) AS conflict_id, m.subject_id, 'cardinality' AS cause,
  ['public', 'internal', 'confidential', 'tlp:amber', 'tlp:red'][1 + max(CASE classification WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'tlp:amber' THEN 3 ELSE 4 END)] AS classification,
  ['public', 'workspace', 'private'][1 + max(CASE visibility WHEN 'public' THEN 0 WHEN 'workspace' THEN 1 ELSE 2 END)] AS visibility
FROM m JOIN f_claims c USING (claim_id) GROUP BY m.ids, m.subject_id""")
def conflict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conflicts.records(_conflicts(spark, sf_dir), fx.claims(spark, sf_dir), "cardinality")
    return found.select("conflict_id", "subject_id", "cause", "classification", "visibility")


@query(_SETS + """, r AS (SELECT ids, ids[1] AS preferred FROM found WHERE len(ids) = 2)
SELECT DISTINCT claim_id FROM (SELECT unnest(ids) AS claim_id, preferred FROM r) WHERE claim_id <> preferred""")
def suppressed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _conflicts(spark, sf_dir).where(F.size("claim_ids") == 2)
    return conflicts.suppressed(pairs.select("claim_ids", F.col("claim_ids")[0].alias("preferred_claim_id")))


# Search

def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), "text")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept index of all texts."""
    return lexical_index.kept(_texts(spark, sf_dir), "texts")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_LEX = """
qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT DISTINCT doc_id AS claim_id, token FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM documents)),
sub AS (SELECT t.term, k.token FROM (SELECT DISTINCT term FROM qt) t JOIN (SELECT DISTINCT token FROM post) k ON contains(k.token, t.term)),
lex0 AS (SELECT query_id, claim_id, CAST(sum(times) AS BIGINT) AS score FROM qt JOIN (SELECT DISTINCT term, claim_id FROM sub JOIN post USING (token)) USING (term) GROUP BY ALL)"""


@query(f"""WITH {_LEX} SELECT query_id, claim_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM lex0) WHERE rank <= 10""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.lexical_top_k(_questions(spark, sf_dir), _index(spark, sf_dir), 10)


def _asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("query_id", F.array_distinct(T.lexical_tokens(F.col("text"))).alias("terms"))


_TF = """
tf AS (SELECT claim_id, token, count(*) AS tf FROM (SELECT doc_id AS claim_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM documents) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS token FROM benchmark)"""


@query(f"""WITH {_TF}, need AS (SELECT query_id, count(*) AS need FROM asked GROUP BY ALL), hit AS (SELECT query_id, claim_id, count(*) AS have, CAST(sum(tf) AS BIGINT) AS score FROM asked JOIN tf USING (token) GROUP BY ALL)
SELECT query_id, claim_id, score, rank FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM hit h JOIN need USING (query_id) WHERE have = need) WHERE rank <= 20""")
def inverted_index_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.full_text_and(_asked_terms(spark, sf_dir), _index(spark, sf_dir), 20)


@query(f"""WITH {_TF} SELECT query_id, claim_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY claim_id) AS rank FROM (SELECT DISTINCT query_id, claim_id FROM asked JOIN tf USING (token))) WHERE rank <= 20""")
def inverted_index_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.full_text_or(_asked_terms(spark, sf_dir), _index(spark, sf_dir), 20)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id"), F.col("embedding").cast("array<double>").alias("vector"))


_VEC = """
v AS (SELECT vec_id AS claim_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
vec AS (SELECT query_id, claim_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM (
  SELECT q.claim_id AS query_id, v.claim_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q CROSS JOIN v WHERE q.claim_id % 100 = 0)) WHERE rank <= 10)"""


@query(f"WITH {_VEC} SELECT * FROM vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return search.vector_top_k(v.where("claim_id % 100 = 0").withColumnRenamed("claim_id", "query_id"), v, 10)


@query()
def vector_ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall@10 of the graph index against the exact lists in three scenarios of filters, and the shares of a tenant's codes and vectors that were read.

    broad: tenant and time; medium: also a namespace that half the vectors have; narrow: also one that a tenth has.
    """
    k = F.col("vec_id")
    first = stamp("2026-01-01 00:00:00")
    v = fx.table(spark, sf_dir, "embeddings").select(
        k.alias("claim_id"), F.when(k % 7 == 0, "other").otherwise("bench").alias("tenant_id"), F.when(k % 10 == 0, "rare").when(k % 3 == 0, "b").otherwise("a").alias("namespace_id"),
        F.when(k % 13 == 0, stamp("2027-01-01 00:00:00")).otherwise(first).alias("valid_from"), F.when(k % 17 == 0, stamp("2026-06-01 00:00:00")).alias("valid_to"), first.alias("recorded_at"), F.col("embedding").cast("array<double>").alias("vector"),
    )
    ways = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(space).cast("string").alias("namespace_id")) for n, space in (("broad", None), ("medium", "a"), ("narrow", "rare"))])
    asked = v.where("claim_id % 100 = 0").select("claim_id", F.posexplode(ways).alias("n", "way"), "vector")
    asked = identity.settle(asked.select((F.col("claim_id") * 3 + F.col("n")).alias("query_id"), "way.scenario", F.lit("bench").alias("tenant_id"), "way.namespace_id", stamp("2026-07-01 00:00:00").alias("valid_at"), stamp("2026-07-01 00:00:00").alias("known_at"), "vector"))
    index = identity.settle(vector_graph.build(v))
    hits = identity.settle(vector_graph.search(index, asked, 10))
    each = evaluate.recall_at_k(search.vector_top_k(asked, v, 10), fusion.top_k(hits.where("claim_id IS NOT NULL"), ["query_id"], 10))
    read = hits.groupBy("query_id", "codes_read", "vectors_read").count().groupBy("query_id").agg(F.sum("codes_read").alias("codes"), F.sum("vectors_read").alias("vectors"))
    held = v.where("tenant_id = 'bench'").agg(F.count(F.lit(1)).alias("held"))
    found = asked.select("query_id", "scenario").join(each, "query_id").join(read, "query_id").crossJoin(F.broadcast(held)).groupBy("scenario")
    return found.agg(F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.count(F.lit(1)).alias("n_queries"), F.avg(F.col("codes") / F.col("held")).alias("codes_read"), F.avg(F.col("vectors") / F.col("held")).alias("vectors_read"))


_LISTS = """
sums AS (SELECT l_suppkey AS query_id, l_partkey AS claim_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL),
lists AS (
  SELECT query_id, 'lexical' AS strategy, claim_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY q DESC, claim_id) AS rank FROM sums) WHERE rank <= 20
  UNION ALL SELECT query_id, 'vector', claim_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, claim_id) AS rank FROM sums) WHERE rank <= 20
)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("claim_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("n"))
    part = lambda s, c: fusion.top_k(sums, ["query_id"], 20, c).select("query_id", F.lit(s).alias("strategy"), "claim_id", "rank")
    return part("lexical", "q").unionByName(part("vector", "n"))


@query(f"""WITH {_LISTS} SELECT query_id, claim_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, round(max(CASE WHEN strategy = 'lexical' THEN 1.0::DOUBLE / (60 + rank) END), 9) AS lexical_component, round(max(CASE WHEN strategy = 'vector' THEN 1.0::DOUBLE / (60 + rank) END), 9) AS vector_component FROM lists GROUP BY ALL""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fusion.reciprocal_rank_fuse(_lists(spark, sf_dir))
    return f.select("query_id", "claim_id", *[F.round(c, 9).alias(c) for c in ("score", "lexical_component", "vector_component")])


@query(f"""WITH {_LISTS}, l AS (SELECT query_id, rank, claim_id FROM lists WHERE strategy = 'lexical'), r AS (SELECT query_id, rank, claim_id FROM lists WHERE strategy = 'vector')
SELECT query_id, bool_and(l.claim_id IS NOT DISTINCT FROM r.claim_id) AS same_order, avg(CASE WHEN l.claim_id IS NOT DISTINCT FROM r.claim_id THEN 0.0::DOUBLE ELSE 1.0 END) AS mismatch FROM l FULL JOIN r USING (query_id, rank) GROUP BY query_id""")
def ranked_list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    return fusion.rank_differences(lists.where("strategy = 'lexical'"), lists.where("strategy = 'vector'"))


_HOPS = f"""WITH {fx.EDGES}, ends AS (SELECT subject_id AS entity, claim_id, object_entity_id AS other, subject_id FROM f_edges UNION ALL SELECT object_entity_id, claim_id, subject_id, subject_id FROM f_edges),
s AS (SELECT c_custkey AS query_id, concat('customer:', CAST(c_custkey AS VARCHAR)) AS entity FROM customer WHERE c_custkey % 100 = 0),
h1 AS (SELECT query_id, claim_id, entity, other, subject_id FROM s JOIN ends USING (entity)), c1 AS (SELECT query_id, claim_id, min(entity) AS route, min(subject_id) AS subject, 1 AS hop FROM h1 GROUP BY query_id, claim_id),
f1 AS (SELECT DISTINCT query_id, other AS entity FROM h1 EXCEPT SELECT query_id, entity FROM s),
h2 AS (SELECT query_id, claim_id, entity, subject_id FROM f1 JOIN ends USING (entity)), c2 AS (SELECT query_id, claim_id, min(entity) AS route, min(subject_id) AS subject, 2 AS hop FROM h2 WHERE NOT EXISTS (SELECT 1 FROM c1 WHERE c1.query_id = h2.query_id AND c1.claim_id = h2.claim_id) GROUP BY query_id, claim_id),
hits AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), fx.text_of("c_custkey", "customer:").alias("entity"))


@query(_HOPS + " SELECT query_id, claim_id, hop, 1.0::DOUBLE / hop AS score, route FROM hits")
def graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_hits(_seeds(spark, sf_dir), fx.edges(spark, sf_dir), 2)


@query(_HOPS + " SELECT query_id, claim_id, hop, 0.3::DOUBLE / hop AS score, subject AS route FROM hits")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_hits(_seeds(spark, sf_dir), fx.edges(spark, sf_dir), 2, "expansion", "subject")


_EMB = """list_transform(generate_series(1, {d}), lambda d: sin(CAST(d * coalesce(list_sum({c}), 0) + coalesce(list_sum(list_transform({c}, lambda x, i: x * (i - 1))), 0) AS DOUBLE)))"""
_CODES = "list_transform(string_split({}, ''), lambda x: CAST(ord(x) AS BIGINT))"


def _emb(text: str, d: int) -> str:
    return _EMB.format(d=d, c=_CODES.format(text))


@query(f"""WITH e AS (SELECT item_id, {_emb('text', 8)} AS r FROM benchmark) SELECT item_id, array_to_string(list_transform(r, lambda x: printf('%.6f', round(x / sqrt(list_sum(list_transform(r, lambda y: y * y))), 6) + 0.0)), ',') AS vector FROM e""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.hash_embedding(F.col("text"), 8)
    return fx.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(v, lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0)), ",").alias("vector"))


PLAN = retrieval.Plan(lexical=30, vector=50, budget=20)


def _doc_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each document that isn't retracted, with its text, scope and times, from its group of five to that of the document eleven behind."""
    d, k = fx.table(spark, sf_dir, "documents"), F.col("doc_id")
    days = lambda base, n: base + F.make_dt_interval(n.cast("int"))
    group = lambda v: F.concat(F.lit("g:"), F.floor(v / 5).cast("string"))
    since = days(F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), k % 600)
    return d.where("doc_id % 13 <> 0").select(
        k.alias("claim_id"), "text", F.when(k % 3 == 0, "south").otherwise("north").alias("tenant_id"), F.col("lang").alias("namespace_id"), F.get(F.lit(CLASSIFICATIONS), F.pmod(k, F.lit(5)).cast("int")).alias("classification"),
        F.when(k % 7 == 0, "private").otherwise("workspace").alias("visibility"), F.concat(F.lit("reader-"), (k % 2).cast("string")).alias("owner_id"),
        since.alias("valid_from"), F.when(k % 4 != 0, days(since, F.lit(300))).alias("valid_to"), days(since, k % 11).alias("recorded_at"), group(k).alias("subject_id"), group(k + 11).alias("object_entity_id"),
    )


def _asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of four readers in turn, at an instant of validity and knowledge or, every other one, at an older as_of; one reader is an agent whose delegation every other question has."""
    k = F.col("query_id")
    who = [
        access.reader("reader-0", "north", ["en", "fr"], "internal", ["viewer"]), access.reader("reader-1", "north", ["fr", "en"], "confidential", ["editor"]),
        access.reader("reader-0", "south", ["en"], "tlp:red", ["viewer"]), access.reader("agent-1", "south", ["de", "en"], "tlp:amber", ["editor"], "agent", "reader-1"),
    ]
    reader = F.get(F.array(*who), F.pmod(k, F.lit(4)).cast("int"))
    both = F.struct(stamp("2021-01-01 00:00:00").alias("valid_at"), stamp("2021-01-05 00:00:00").alias("known_at"))
    questions = _questions(spark, sf_dir).select(
        "query_id", "text", T.hash_embedding(F.col("text"), 8).alias("vector"), reader.alias("reader"), F.when(k % 2 == 0, both).alias("temporal"), F.when(k % 2 == 1, stamp("2020-10-01 00:00:00")).alias("as_of"),
        F.lit("audit").alias("purpose"), F.when(k % 8 == 3, access.delegation("reader-1", ["knowledge.read"], "2025-01-01 00:00:00", "audit")).alias("delegation"),
    )
    return identity.settle(perspective.asked(questions))


def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document is preferred to the next one, for its own tenant."""
    d = fx.table(spark, sf_dir, "documents").where("doc_id % 50 = 0")
    tenant = F.when(F.col("doc_id") % 3 == 0, "south").otherwise("north")
    return conflicts.suppressed(d.select(tenant.alias("tenant_id"), F.array("doc_id", F.col("doc_id") + 1).alias("claim_ids"), F.col("doc_id").alias("preferred_claim_id")))


def _hybrid(spark: SparkSession, sf_dir: str, how) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    held, questions = _doc_claims(spark, sf_dir), _asking(spark, sf_dir)
    place = ["tenant_id", "namespace_id", "valid_from", "valid_to", "recorded_at"]
    vectors = identity.settle(held.select("claim_id", T.hash_embedding(F.col("text"), 8).alias("vector"), *place))  # written, so that no task holds texts and vectors in two Python processes at once
    hits = how(questions, lexical_index.kept(held.select("claim_id", "text", *place), "claims"), vectors, PLAN, held.select("claim_id", "subject_id", "object_entity_id", *place))
    scope = held.select("claim_id", "tenant_id", "namespace_id", "classification", "visibility", "owner_id")
    return (*retrieval.answer(hits, scope, questions, stamp(NOW), PLAN, _suppressed(spark, sf_dir)), questions)


_HYBRID = f"""WITH {_LEX}, asks AS (
  SELECT item_id AS query_id, text, ['reader-0', 'reader-1', 'reader-0', 'agent-1'][1 + item_id % 4] AS principal_id, CASE WHEN item_id % 4 < 2 THEN 'north' ELSE 'south' END AS tenant_id, ['en', 'fr', 'en', 'de'][1 + item_id % 4] AS namespace_id,
    [1, 2, 4, 3][1 + item_id % 4] AS clearance, ['reader-0', 'reader-1', 'reader-0', 'reader-1'][1 + item_id % 4] AS acting_as, item_id % 8 = 7 AS undelegated,
    CASE WHEN item_id % 2 = 0 THEN TIMESTAMP '2021-01-01' ELSE TIMESTAMP '2020-10-01' END AS valid_at, CASE WHEN item_id % 2 = 0 THEN TIMESTAMP '2021-01-05' END AS known_at FROM benchmark
), held AS (
  SELECT doc_id AS claim_id, text, CASE WHEN doc_id % 3 = 0 THEN 'south' ELSE 'north' END AS tenant_id, lang AS namespace_id, doc_id % 5 AS level, doc_id % 7 = 0 AS private, concat('reader-', doc_id % 2) AS owner_id,
    TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 600 AS INTEGER)) AS valid_from, CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 600 + 300 AS INTEGER)) END AS valid_to,
    TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 600 + doc_id % 11 AS INTEGER)) AS recorded_at FROM documents WHERE doc_id % 13 <> 0
), open AS (
  SELECT query_id, claim_id FROM asks q JOIN held c USING (tenant_id, namespace_id) WHERE c.valid_from <= q.valid_at AND (c.valid_to IS NULL OR q.valid_at < c.valid_to) AND (q.known_at IS NULL OR c.recorded_at <= q.known_at)
), lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM lex0 JOIN open USING (query_id, claim_id)) WHERE rank <= 30),
qe AS (SELECT item_id AS query_id, {_emb('text', 8)} AS e FROM benchmark), de AS (SELECT doc_id AS claim_id, {_emb('text', 8)} AS e FROM documents),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM (SELECT query_id, claim_id, round(list_cosine_similarity(qe.e, de.e), 6) AS score FROM open JOIN qe USING (query_id) JOIN de USING (claim_id)) WHERE score >= 0.15) WHERE rank <= 50),
acl AS (
  SELECT query_id, claim_id, q.principal_id, ['public', 'internal', 'confidential', 'tlp:amber', 'tlp:red'][1 + c.level] AS classification,
    CASE WHEN q.clearance < c.level THEN 'CLASSIFICATION_DENIED' WHEN q.undelegated THEN 'DELEGATION_DENIED' WHEN c.private AND c.owner_id <> q.acting_as THEN 'VISIBILITY_DENIED' ELSE 'ALLOW' END AS reason
  FROM open JOIN asks q USING (query_id) JOIN held c USING (claim_id) WHERE NOT (claim_id % 50 = 1 AND CASE WHEN (claim_id - 1) % 3 = 0 THEN 'south' ELSE 'north' END = q.tenant_id)
),
edge AS (SELECT claim_id, concat('g:', CAST(claim_id // 5 AS VARCHAR)) AS s, concat('g:', CAST((claim_id + 11) // 5 AS VARCHAR)) AS o FROM held),
ends AS (SELECT s AS entity, claim_id, o AS other, s FROM edge UNION ALL SELECT o, claim_id, s, s FROM edge),
first AS (SELECT query_id, claim_id FROM lex UNION SELECT query_id, claim_id FROM vec),
f0 AS (SELECT DISTINCT query_id, entity FROM first JOIN ends USING (claim_id)),
h1 AS (SELECT query_id, claim_id, entity, other, s FROM f0 JOIN ends USING (entity) JOIN open USING (query_id, claim_id)), f1 AS (SELECT DISTINCT query_id, other AS entity FROM h1 EXCEPT SELECT query_id, entity FROM f0),
h2 AS (SELECT query_id, claim_id, entity, other, s FROM f1 JOIN ends USING (entity) JOIN open USING (query_id, claim_id)),
near AS (SELECT query_id, claim_id, min(hop) AS hop, arg_min(entity, (hop, entity)) AS route FROM (SELECT query_id, claim_id, 1 AS hop, entity FROM h1 UNION ALL SELECT query_id, claim_id, 2, entity FROM h2) GROUP BY ALL HAVING (query_id, claim_id) NOT IN (SELECT (query_id, claim_id) FROM first))"""

_ADDED = _HYBRID + """, hit AS (SELECT query_id, claim_id, round(coalesce(CAST(lex.score AS DOUBLE), 0.0) + coalesce(vec.score, 0.0), 6) AS score, lex.score AS lexical, vec.score AS vector, NULL AS graph FROM lex FULL JOIN vec USING (query_id, claim_id)
  UNION ALL SELECT query_id, claim_id, round(0.3::DOUBLE / hop, 6), NULL, NULL, hop FROM near),
shown AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM hit h JOIN acl USING (query_id, claim_id) WHERE reason = 'ALLOW') WHERE rank <= 20)"""


@query(_ADDED + " SELECT query_id, claim_id, score, rank FROM shown")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, retrieval.additive)[0].select("query_id", "claim_id", "score", "rank")


_FUSED = _HYBRID + """, part AS (SELECT query_id, claim_id, 1.0::DOUBLE / (60 + rank) AS c, NULL AS route FROM lex UNION ALL SELECT query_id, claim_id, 1.0::DOUBLE / (60 + rank), NULL FROM vec
  UNION ALL SELECT query_id, claim_id, 1.0::DOUBLE / (60 + rank), route FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, claim_id) AS rank FROM near) WHERE rank <= 40),
hit AS (SELECT query_id, claim_id, sum(c) AS score, max(route) AS route FROM part GROUP BY ALL), shown AS (SELECT * FROM (SELECT h.query_id, h.claim_id, route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM hit h JOIN acl USING (query_id, claim_id) WHERE reason = 'ALLOW') WHERE rank <= 20)"""


@query(_FUSED + " SELECT query_id, claim_id, rank, route FROM shown")
def fused_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, retrieval.fused)[0].select("query_id", "claim_id", "rank", "route")


@query(_FUSED + " SELECT query_id, classification, count(*) AS omitted FROM hit JOIN acl USING (query_id, claim_id) WHERE reason <> 'ALLOW' GROUP BY ALL")
def retrieval_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, retrieval.fused)[1]


@query(_FUSED + " SELECT query_id, principal_id, 'knowledge.read' AS action, 'claim' AS resource_kind, claim_id AS resource_id, CASE WHEN reason = 'ALLOW' THEN 'allow' ELSE 'deny' END AS effect, reason FROM hit JOIN acl USING (query_id, claim_id)")
def retrieval_authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access receipts of every hit, allowed or denied."""
    return _hybrid(spark, sf_dir, retrieval.fused)[2].drop("evaluated_at")


@query(_ADDED + """, said AS (SELECT query_id, string_agg(concat(claim_id, ' ', array_to_string(list_filter([CASE WHEN lexical IS NOT NULL THEN concat('lexical ', lexical) END, CASE WHEN vector IS NOT NULL THEN concat('vector ', printf('%.2f', vector)) END,
  CASE WHEN graph IS NOT NULL THEN 'graph neighborhood' END], lambda x: x IS NOT NULL), '; '), ' ', source), ' | ' ORDER BY rank) AS selected FROM shown JOIN documents ON doc_id = claim_id GROUP BY query_id),
judged AS (SELECT query_id, claim_id, classification, reason FROM hit JOIN acl USING (query_id, claim_id)),
lost AS (SELECT query_id, string_agg(concat(classification, ' ', n), ' | ' ORDER BY classification) AS omissions FROM (SELECT query_id, classification, count(*) AS n FROM judged WHERE reason <> 'ALLOW' GROUP BY ALL) GROUP BY query_id),
allow AS (SELECT query_id, string_agg(concat(claim_id, ' ', reason), ' | ' ORDER BY claim_id) AS authorizations FROM judged GROUP BY query_id)
SELECT query_id, sha256(text) AS query_hash, principal_id, tenant_id, namespace_id, 'audit' AS purpose, valid_at, known_at, 'retrieval-v2' AS plan_version, selected, omissions, authorizations FROM asks LEFT JOIN said USING (query_id) LEFT JOIN lost USING (query_id) LEFT JOIN allow USING (query_id)""")
def retrieval_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, omitted, allow, asked = _hybrid(spark, sf_dir, retrieval.additive)
    proof = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("source").alias("evidence_id"))
    found = retrieval.receipts(ranked, omitted, asked, allow, proof)
    joined = lambda c, f: F.array_join(F.transform(c, f), " | ").alias(c)
    return found.select(
        "query_id", "query_hash", "principal_id", "tenant_id", "namespace_id", "purpose", "valid_at", "known_at", "plan_version",
        joined("selected", lambda x: F.concat_ws(" ", x["claim_id"].cast("string"), x["reason"], F.array_join(x["evidence_ids"], " "))), joined("omissions", lambda x: F.concat_ws(" ", x["classification"], x["omitted"].cast("string"))),
        joined("authorizations", lambda x: F.concat_ws(" ", x["resource_id"].cast("string"), x["reason"])),
    )


@query(f"""WITH {_LEX}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM lex0) WHERE rank <= 10),
src AS (SELECT doc_id AS claim_id, source AS evidence_id FROM documents), seen AS (SELECT query_id, evidence_id, min(rank) AS rank FROM top JOIN src USING (claim_id) GROUP BY ALL)
SELECT query_id, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY rank) AS claim_ids, (SELECT string_agg(evidence_id, ',' ORDER BY rank) FROM seen s WHERE s.query_id = t.query_id) AS evidence_ids FROM top t GROUP BY query_id""")
def context_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical_index.lexical_top_k(_questions(spark, sf_dir), _index(spark, sf_dir), 10)
    proof = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("source").alias("evidence_id"))
    s = decisions.snapshots(hits, proof)
    return s.select("query_id", F.array_join(F.transform("claim_ids", lambda x: x.cast("string")), ",").alias("claim_ids"), F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query(f"""WITH {_LEX}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM lex0) WHERE rank <= 10),
rel AS (SELECT item_id AS query_id, doc_id AS claim_id FROM benchmark JOIN labels ON quality = 1 AND doc_id % 40 = item_id % 40),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM top JOIN rel USING (query_id, claim_id) GROUP BY ALL), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL)
SELECT count(*) AS cases, round(avg(coalesce(hits, 0) / 10.0::DOUBLE), 9) AS precision_at_k, round(avg(coalesce(CAST(hits AS DOUBLE) / n, 0)), 9) AS recall_at_k, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_rate_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr
FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN h USING (query_id) LEFT JOIN n USING (query_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir)
    good = fx.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") % 40).alias("k"))
    relevant = asked.select("query_id", (F.col("query_id") % 40).alias("k")).join(good, "k").select("query_id", "claim_id")
    m = evaluate.retrieval_metrics(lexical_index.lexical_top_k(asked, _index(spark, sf_dir), 10), relevant, asked, 10)
    return m.select("cases", *[F.round(c, 9).alias(c) for c in m.columns[1:]])


# Ingestion

_SENT = r"""
sent AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS place FROM documents),
said AS (SELECT doc_id, place, sentence FROM sent WHERE sentence <> '' AND regexp_matches(sentence, '(?i)(^|[^A-Za-z0-9_])(is|are|was|were)($|[^A-Za-z0-9_])')),
parts AS (SELECT doc_id, CAST(place AS INTEGER) AS place, regexp_extract(sentence, '(?is)^(.*?)(^|[^A-Za-z0-9_])(is|are|was|were)($|[^A-Za-z0-9_])(.*)$', ['a', 'b', 'c', 'd', 'e']) AS m FROM said)"""


@query(rf"""WITH {_SENT} SELECT doc_id, place, trim(concat(m.a, m.b)) AS subject_label, 'is' AS predicate, trim(concat(m.d, m.e)) AS object_value, 0.8::DOUBLE AS confidence FROM parts
UNION ALL SELECT doc_id, -1, 'document', 'mentions', substr(text, 1, 80), 1.0 FROM documents""")
def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.drafts(fx.table(spark, sf_dir, "documents"))


@query("""WITH d AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR), '.txt') AS uri, text AS content, 'text/plain' AS mime FROM documents UNION ALL SELECT concat('page/', CAST(page_id AS VARCHAR), '.html'), html, 'application/octet-stream' FROM pages)
SELECT uri, mime, sha256(content) AS content_hash, concat('evidence/', sha256(content), '/', uri) AS blob_key FROM d""")
def evidence_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select(F.concat(fx.text_of("doc_id", "doc/"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    p = fx.table(spark, sf_dir, "pages").select(F.concat(fx.text_of("page_id", "page/"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    rows = d.union(p).withColumns({"mime": T.mime_of(F.col("path")), "content": F.col("content").cast("binary")})
    return extract.evidence(rows).select("uri", "mime", "content_hash", "blob_key")


@query(rf"""WITH {_SENT}, made AS (SELECT doc_id, place, lower(trim(trim(concat(m.a, m.b)))) AS entity, 'is' AS predicate, trim(concat(m.d, m.e)) AS object_value FROM parts UNION ALL SELECT doc_id, -1, 'document', 'mentions', substr(text, 1, 80) FROM documents),
told AS (SELECT *, min(object_value) OVER w AS low, max(object_value) OVER w AS high FROM (SELECT *, sha256(concat(CAST(doc_id AS VARCHAR), chr(1), CAST(place AS VARCHAR))) AS claim_id FROM made) WINDOW w AS (PARTITION BY entity, predicate ORDER BY claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT predicate, CASE WHEN low <> object_value OR high <> object_value THEN 'conflicted' ELSE 'asserted' END AS status, count(*) AS n FROM told GROUP BY ALL UNION ALL SELECT 'entity', 'distinct', count(DISTINCT entity) FROM made""")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims of each status and entities an ingest of all documents makes."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text", stamp(NOW).alias("recorded_at"))
    made = extract.ingest(docs, "local", "default", 8)
    facts = made["claims"].groupBy("predicate", "status").agg(F.count(F.lit(1)).alias("n"))
    return facts.unionByName(made["entities"].agg(F.lit("entity").alias("predicate"), F.lit("distinct").alias("status"), F.count(F.lit(1)).alias("n")))


@query(f"WITH {fx.CLAIMS} SELECT DISTINCT predicate FROM f_claims")
def distinct_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.claims(spark, sf_dir).select("predicate").distinct()


# Contracts

PREDICATES = """SELECT * FROM VALUES
 ('order_status', 0, 'urn:order_status', array('orderStatus'), array('Customer'), 'literal', CAST(array() AS array<string>), 'string', CAST(NULL AS string), array(named_struct('kind', 'enum', 'values', array('F', 'O'), 'pattern', CAST(NULL AS string), 'length', CAST(NULL AS int))), 1, 12)
 AS t(id, position, iri, aliases, domain, range_kind, range_types, datatype, datatype_iri, rules, min_count, max_count)"""


def _predicates(spark: SparkSession) -> DataFrame:
    return spark.sql(PREDICATES)


@query(f"""WITH {fx.CLAIMS} SELECT claim_id, CASE WHEN status = 'retracted' THEN 'UNKNOWN_PREDICATE' ELSE array_to_string(list_filter([CASE WHEN visibility = 'private' THEN 'DOMAIN_MISMATCH' END, CASE WHEN object_value = 'P' THEN 'VALUE_RULE_VIOLATION' END], lambda x: x IS NOT NULL), ',') END AS issues FROM f_claims""")
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.claims(spark, sf_dir).select(
        "claim_id", F.when(F.col("status") == "retracted", "gone").otherwise(F.col("predicate")).alias("predicate"), F.lit("literal").alias("object_kind"), "object_value", F.lit(None).cast("string").alias("object_datatype"),
        F.array(F.when(F.col("visibility") == "private", "Ghost").otherwise("Customer")).alias("subject_types"), F.array().cast("array<string>").alias("object_types"),
    )
    return contracts.claim_issues(c, _predicates(spark)).select("claim_id", F.array_join("issues", ",").alias("issues"))


@query("""WITH t AS (SELECT DISTINCT p_type AS id FROM part), par AS (SELECT DISTINCT p_type AS type_id, p_brand AS parent_id FROM part WHERE p_size = 3)
SELECT 'UNKNOWN_PARENT' AS code, type_id AS path FROM par UNION ALL SELECT 'DUPLICATE_ID', p_name FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'BAD_CARDINALITY', p_name FROM part WHERE p_size > 40 UNION ALL SELECT 'BAD_LENGTH', p_name FROM part WHERE p_size < 3 UNION ALL SELECT 'BAD_PATTERN', p_name FROM part WHERE p_size = 7""")
def contract_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part")
    types = p.select(F.col("p_type").alias("id")).distinct()
    parents = p.where("p_size = 3").select(F.col("p_type").alias("type_id"), F.col("p_brand").alias("parent_id")).distinct()
    rule = lambda kind, pattern, length: F.struct(F.lit(kind).alias("kind"), F.lit(pattern).cast("string").alias("pattern"), F.lit(length).cast("int").alias("length"))
    rules = F.array(F.when(F.col("p_size") < 3, rule("min-length", None, -1)).when(F.col("p_size") == 7, rule("pattern", "([", None)).otherwise(rule("pattern", "^a", None)))
    none = F.array().cast("array<string>")
    predicates = p.select(F.col("p_name").alias("id"), none.alias("domain"), none.alias("range_types"), rules.alias("rules"), F.lit(1).alias("min_count"), F.when(F.col("p_size") > 40, 0).otherwise(2).alias("max_count"))
    return contracts.lint(types, parents, predicates, graph.cyclic_types(parents))


@query(f"""WITH {fx.CLAIMS}, n AS (SELECT concat('customer:', CAST(c_custkey AS VARCHAR)) AS entity_id, (SELECT count(*) FROM f_claims f WHERE f.subject_id = concat('customer:', CAST(c_custkey AS VARCHAR))) AS n FROM customer)
SELECT entity_id, 'order_status' AS predicate_id, n, CASE WHEN n < 1 THEN 'MIN_ITEMS' ELSE 'MAX_ITEMS' END AS code FROM n WHERE n < 1 OR n > 12""")
def entity_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = fx.table(spark, sf_dir, "customer").select(fx.text_of("c_custkey", "customer:").alias("entity_id"), F.lit("Buyer").alias("type_id"))
    closure = graph.type_closure(spark.sql("SELECT 'Buyer' AS type_id, 'Customer' AS parent_id"))
    return contracts.entity_shape(fx.claims(spark, sf_dir), entities, closure, _predicates(spark))


# Policies and decisions

_RULES = f"""(d.confidence < p.min_confidence) IS TRUE AS a, (p.allowed_outcomes IS NOT NULL AND NOT list_contains(p.allowed_outcomes, d.selected_outcome)) AS b,
    (list_position(['public', 'internal', 'confidential', 'tlp:amber', 'tlp:red'], d.classification) - 1 > p.max_level) IS TRUE AS c, p.min_confidence AS m, ['public', 'internal', 'confidential', 'tlp:amber', 'tlp:red'][1 + p.max_level] AS top"""
_LISTED = """(p.purposes IS NULL OR list_contains(p.purposes, d.purpose)) AND (p.namespace_ids IS NULL OR list_contains(p.namespace_ids, d.namespace_id)) AND (p.classifications IS NULL OR list_contains(p.classifications, d.classification))
  AND p.status = 'active' AND (p.effective_from IS NULL OR d.recorded_at >= p.effective_from) AND (p.effective_to IS NULL OR d.recorded_at < p.effective_to)"""
_POL = f"""WITH {fx.DECISIONS}, {fx.POLICIES.strip()}, app AS (SELECT d.*, p.policy_id, p.version, {_RULES} FROM f_decisions d JOIN f_policies p ON {_LISTED})"""
_BROKEN = """list_filter([CASE WHEN a THEN concat('confidence below ', CASE m WHEN 0.25 THEN '0.25' WHEN 0.5 THEN '0.5' ELSE '0.75' END) END, CASE WHEN b THEN concat('outcome ', selected_outcome, ' is not allowed') END, CASE WHEN c THEN concat('classification exceeds ', top) END], lambda x: x IS NOT NULL)"""


@query(_POL + f" SELECT decision_id, policy_id, version, NOT a AND NOT b AND NOT c AS compliant, array_to_string({_BROKEN}, '; ') AS violations FROM app")
def policy_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.evaluate(fx.decisions(spark, sf_dir), fx.policies(spark, sf_dir), joined="; ")


@query(_POL + " SELECT decision_id, policy_id, version FROM app")
def policy_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.applicable_policies(fx.decisions(spark, sf_dir).select("decision_id", "purpose", "namespace_id", "classification", "recorded_at"), fx.policies(spark, sf_dir), ["policy_id", "version"]).select("decision_id", "policy.policy_id", "policy.version")


@query(f"""WITH {fx.DECISIONS}, {fx.POLICIES.strip()}, app AS (SELECT d.*, p.policy_id, p.version, {_RULES} FROM f_decisions d CROSS JOIN f_policies p WHERE p.version % 1000 = 4)
SELECT decision_id, policy_id, version, a OR b OR c AS would_fail, array_to_string({_BROKEN}, '; ') AS violations FROM app""")
def policy_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision against the candidate versions, one in a thousand, applicable or not."""
    return policy.what_if(fx.decisions(spark, sf_dir), fx.policies(spark, sf_dir).where("version % 1000 = 4"), joined="; ")


@query(f"""WITH {fx.DECISIONS}, {fx.DECISION_CLAIMS}, t AS (SELECT * FROM f_decisions WHERE decision_id % 100 = 0), n AS (SELECT decision_id, count(*) AS n FROM f_decision_claims GROUP BY ALL),
c AS (SELECT a.decision_id AS t, b.decision_id AS d, count(*) AS c FROM f_decision_claims a JOIN f_decision_claims b USING (claim_id) WHERE a.decision_id % 100 = 0 AND a.decision_id <> b.decision_id GROUP BY ALL),
s AS (SELECT t.decision_id, d.decision_id AS precedent_id, coalesce(c.c, 0) AS c, d.selected_outcome = t.selected_outcome AS same_o, d.purpose = t.purpose AS same_p, round(0.6 * coalesce(CAST(c.c AS DOUBLE) / (nt.n + nd.n - c.c), 0) + CASE WHEN d.selected_outcome = t.selected_outcome THEN 0.25 ELSE 0.0 END + CASE WHEN d.purpose = t.purpose THEN 0.15 ELSE 0.0 END, 9) AS score
  FROM t JOIN f_decisions d ON d.decision_id <> t.decision_id LEFT JOIN c ON c.t = t.decision_id AND c.d = d.decision_id LEFT JOIN n nt ON nt.decision_id = t.decision_id LEFT JOIN n nd ON nd.decision_id = d.decision_id)
SELECT decision_id, precedent_id, CAST(score AS DOUBLE) AS score, place, array_to_string(list_filter([CASE WHEN c > 0 THEN 'shared context' END, CASE WHEN same_o THEN 'same outcome' END, CASE WHEN same_p THEN 'same purpose' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, precedent_id) AS place FROM s WHERE score > 0) WHERE place <= 5""")
def decision_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.decisions(spark, sf_dir)
    return decisions.precedents(d, fx.decision_claims(spark, sf_dir), d.where("decision_id % 100 = 0").select("decision_id")).withColumn("reasons", F.array_join("reasons", ", "))


@query(_POL + f""", refs AS (SELECT decision_id, CASE WHEN confidence < 0.1 THEN 'p-gone' ELSE policy_id END AS policy_id, version FROM app),
lost AS (SELECT decision_id, string_agg(concat(policy_id, '@', version), ',' ORDER BY concat(policy_id, '@', version)) AS lost FROM refs WHERE policy_id = 'p-gone' GROUP BY decision_id),
told AS (SELECT d.decision_id, lost, CASE WHEN c.c_custkey IS NULL THEN concat('snapshot:', 's-', d.actor) WHEN c.c_nationkey % 5 = 0 THEN concat('receipt:', 'r-', c.c_nationkey) END AS gone FROM f_decisions d LEFT JOIN lost USING (decision_id) LEFT JOIN customer c ON c.c_custkey = d.actor AND c.c_acctbal > 0)
SELECT decision_id, lost IS NULL AND gone IS NULL AS complete, concat_ws(',', lost, gone) AS missing FROM told""")
def decision_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision against the policy versions, the snapshots of customers in credit, and the receipts of four nations in five."""
    unsure = F.col("confidence") < 0.1
    d = fx.decisions(spark, sf_dir).withColumn("snapshot_id", fx.text_of("actor", "s-"))
    held = fx.policies(spark, sf_dir)
    kept = fx.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(fx.text_of("c_custkey", "s-").alias("snapshot_id"), fx.text_of("c_nationkey", "r-").alias("receipt_id"))
    receipts = fx.table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(fx.text_of("n_nationkey", "r-").alias("receipt_id"))
    told = lambda some, named: decisions.replay_applicable(d.where(some), named, held, kept, receipts)
    return told(unsure, held.withColumn("policy_id", F.lit("p-gone"))).unionByName(told(~F.coalesce(unsure, F.lit(False)), held))


@query(f"""WITH {fx.DECISIONS}, {fx.POLICIES.strip()}, r AS (SELECT d.* REPLACE (TIMESTAMP '1995-06-01' AS recorded_at), c.c_custkey IS NULL AS bare, decision_id % 13 = 0 AS hidden FROM f_decisions d LEFT JOIN customer c ON c_custkey = actor AND c_acctbal > 0),
app AS (SELECT d.decision_id, {_RULES} FROM r d JOIN f_policies p ON {_LISTED} WHERE NOT bare AND NOT hidden), judged AS (SELECT decision_id, count(*) AS evaluated, count(*) FILTER (a OR b OR c) AS violated FROM app GROUP BY ALL)
SELECT decision_id AS request_id, CASE WHEN bare OR hidden THEN array_to_string(list_filter([CASE WHEN bare THEN 'CONTEXT_SNAPSHOT_REQUIRED' END, CASE WHEN hidden THEN 'HIDDEN_REASONING' END], lambda x: x IS NOT NULL), ',') ELSE 'recorded' END AS state,
coalesce(evaluated, 0) AS evaluated, coalesce(violated, 0) AS violated FROM r LEFT JOIN judged USING (decision_id)""")
def decision_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a decision request; customers in credit have a context snapshot, every thirteenth payload carries hidden reasoning."""
    given = fx.decisions(spark, sf_dir).withColumnRenamed("decision_id", "request_id").withColumn("query_id", F.col("actor"))
    payload = F.when(F.col("request_id") % 13 == 0, '{"hiddenCoT": "x"}').otherwise('{"note": "x"}')
    requests = given.select("request_id", "query_id", "actor", "purpose", "selected_outcome", "confidence", "namespace_id", "classification", payload.alias("payload"))
    credit = fx.table(spark, sf_dir, "customer").where("c_acctbal > 0")
    kept = credit.select(F.col("c_custkey").alias("query_id"), fx.text_of("c_custkey", "s-").alias("snapshot_id"), F.array().cast("array<string>").alias("evidence_ids"), F.array().cast("array<struct<policy_id:string,version:int>>").alias("policy_refs"))
    made = decisions.record(requests, kept, fx.policies(spark, sf_dir), stamp("1995-06-01 00:00:00"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    good = made["decisions"].join(made["tally"], "decision_id", "left").select("request_id", F.lit("recorded").alias("state"), zero("evaluated"), zero("violated"))
    return good.unionByName(made["rejected"].select("request_id", F.array_join("errors", ",").alias("state"), F.lit(0).cast("long").alias("evaluated"), F.lit(0).cast("long").alias("violated")))


_AUDIT = f"""{_POL}, {fx.DECISION_CLAIMS.strip()}, {fx.EVENTS.strip()}, v AS (SELECT DISTINCT l_partkey AS claim_id, l_shipdate AS at, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'retracted' WHEN 'A' THEN 'conflicted' ELSE 'asserted' END AS status FROM lineitem),
p AS (SELECT c.decision_id, c.claim_id, v.status, row_number() OVER (PARTITION BY c.decision_id, c.claim_id ORDER BY v.at DESC, v.seq DESC, v.status DESC) AS n FROM f_decision_claims c JOIN f_decisions d USING (decision_id) JOIN v ON v.claim_id = c.claim_id AND v.at <= d.recorded_at),
ev AS (SELECT DISTINCT decision_id, event_id, kind FROM (SELECT d.decision_id, e.event_id, e.kind FROM f_decisions d JOIN f_events e ON e.claim_id = d.decision_id UNION ALL SELECT c.decision_id, e.event_id, e.kind FROM f_decision_claims c JOIN f_events e ON e.claim_id = c.claim_id)),
item AS (
  SELECT 'claims' AS section, decision_id, claim_id AS a, '' AS z, concat('{{"claim_id":', claim_id, ',"status":"', status, '"}}') AS j FROM p WHERE n = 1 AND status <> 'retracted'
  UNION ALL SELECT 'events', decision_id, event_id, kind, concat('{{"event_id":', event_id, ',"kind":"', kind, '"}}') FROM ev
  UNION ALL SELECT DISTINCT 'evidence', l_orderkey, l_suppkey, '', concat('{{"evidence_id":', l_suppkey, '}}') FROM lineitem
  UNION ALL SELECT 'policy_versions', decision_id, version, policy_id, concat('{{"version":', version, ',"policy_id":"', policy_id, '"}}') FROM app
  UNION ALL SELECT DISTINCT 'authorization_receipts', l_orderkey, l_partkey, l_linestatus, concat('{{"claim_id":', l_partkey, ',"effect":"', CASE WHEN l_linestatus = 'F' THEN 'deny' ELSE 'allow' END, '"}}') FROM lineitem
  UNION ALL SELECT DISTINCT 'relations', l_orderkey, l_partkey, '', concat('{{"to_id":', l_partkey, '}}') FROM lineitem WHERE l_orderkey <> l_partkey
  UNION ALL SELECT section, claim_id, event_id, '', concat('{{"event_id":', event_id, '}}') FROM (SELECT CASE kind WHEN 'decision.recorded' THEN 'outcomes' WHEN 'claim.retracted' THEN 'exceptions' ELSE 'approvals' END AS section, * FROM f_events WHERE kind IN ('decision.recorded', 'claim.retracted', 'context.accessed')) WHERE claim_id IS NOT NULL
), bundle AS (SELECT decision_id, section, count(*) AS n, sha256(concat('[', string_agg(j, ',' ORDER BY a, CASE WHEN section = 'authorization_receipts' THEN CASE WHEN z = 'F' THEN '2' ELSE '1' END ELSE z END), ']')) AS h FROM item GROUP BY decision_id, section)"""
_AUDIT_NAMES = ["claims", "events", *decisions.SECTIONS]


@query(_AUDIT + " SELECT decision_id, " + ", ".join(f"CAST(coalesce(max(n) FILTER (section = '{c}'), 0) AS BIGINT) AS n_{c}" for c in _AUDIT_NAMES) + " FROM f_decisions LEFT JOIN bundle USING (decision_id) GROUP BY decision_id")
def decision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir, hashed=False).drop("manifest")


@query(_AUDIT + " SELECT decision_id, " + ", ".join(f"coalesce(max(h) FILTER (section = '{c}'), sha256('[]')) AS {c}_sha256" for c in _AUDIT_NAMES) + " FROM f_decisions LEFT JOIN bundle USING (decision_id) GROUP BY decision_id")
def audit_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).select("decision_id", *[F.col("manifest")[c].alias(f"{c}_sha256") for c in _AUDIT_NAMES])


def _audit(spark: SparkSession, sf_dir: str, hashed: bool = True) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "retracted").when(F.col("l_returnflag") == "A", "conflicted").otherwise("asserted")
    lines = fx.table(spark, sf_dir, "lineitem")
    versions = lines.select(F.col("l_partkey").alias("claim_id"), F.col("l_shipdate").alias("recorded_at"), F.col("l_linenumber").alias("version_seq"), status.alias("status"))
    events = fx.event_log(fx.table(spark, sf_dir, "events"))
    told = events.where(F.col("claim_id").isNotNull()).select(F.col("claim_id").alias("decision_id"), "event_id", "kind")
    fact = lambda kind: (told, F.when(F.col("kind") == kind, F.struct("event_id")))
    line = lines.select(F.col("l_orderkey").alias("decision_id"), F.col("l_partkey").alias("to_id"), F.col("l_suppkey").alias("evidence_id"), F.when(F.col("l_linestatus") == "F", "deny").otherwise("allow").alias("effect"))
    d, claim = fx.decisions(spark, sf_dir), F.col("to_id").alias("claim_id")
    sections = {
        "evidence": (line, F.struct("evidence_id")),
        "policy_versions": policy.folded_policies(d, fx.policies(spark, sf_dir), F.to_json(F.struct("version", "policy_id")), ["version", "policy_id"], "sha256" if hashed else None, ["decision_id"]),
        "authorization_receipts": (line, F.struct(claim, "effect")),
        "relations": (line, F.when(F.col("decision_id") != F.col("to_id"), F.struct("to_id"))),
        "outcomes": fact("decision.recorded"), "exceptions": fact("claim.retracted"), "approvals": fact("context.accessed"),
    }
    return decisions.audit(d, line.select("decision_id", claim), versions, events, sections)


@query(f"""WITH {fx.DECISIONS}, {fx.DECISION_CLAIMS}, used AS (SELECT decision_id, string_agg(concat('"', e, '"'), ',' ORDER BY e) AS used FROM (SELECT DISTINCT decision_id, concat('evidence:', CAST(claim_id AS VARCHAR)) AS e FROM f_decision_claims) GROUP BY decision_id)
SELECT decision_id, concat('{{"type":"prov:Activity","id":"decision:', decision_id, '","wasAssociatedWith":"agent:', actor, '"', CASE WHEN used IS NOT NULL THEN concat(',"used":[', used, ']') ELSE '' END, ',"endedAtTime":"', strftime(recorded_at, '%Y-%m-%dT%H:%M:%S'), '"}}') AS prov
FROM f_decisions LEFT JOIN used USING (decision_id)""")
def prov_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.provenance_json(fx.decisions(spark, sf_dir), fx.decision_claims(spark, sf_dir))


@query(f"""WITH {fx.DECISIONS} SELECT decision_id, place, place // 50 AS page FROM (SELECT decision_id, row_number() OVER (ORDER BY recorded_at NULLS FIRST, decision_id) - 1 AS place FROM f_decisions)""")
def decision_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of fifty and the place of every decision in the order of their recording."""
    return listing.pages(fx.decisions(spark, sf_dir).select("decision_id", "recorded_at"), ["recorded_at", "decision_id"], 50).drop("recorded_at")


# Memory, events, measures

@query(f"""WITH {fx.MEMORY}, q AS (SELECT * FROM (VALUES (1, 'THE', 'user-3', 1), (2, '', 'user-5', 0), (3, 'que', 'user-3', 1)) AS v(query_id, text, principal_id, clearance))
SELECT query_id, conv_id, turn, owner_id, kind FROM f_memory m JOIN q ON contains(lower(coalesce(m.body, '')), lower(q.text)) WHERE q.clearance >= CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AND (kind <> 'note' OR owner_id = q.principal_id)""")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions of two readers over all memories; one is empty and finds all that its reader may read."""
    scope = {"tenant_id": F.lit("local"), "namespace_id": F.lit("default"), "classification": F.when(F.col("turn") % 3 == 0, "public").otherwise("internal"), "visibility": F.when(F.col("kind") == "note", "private").otherwise("workspace")}
    who = [access.reader("user-3", "local", ["default"], "internal", ["editor"]), access.reader("user-5", "local", ["default"], "public", ["editor"])]
    asked = [F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("text"), w.alias("reader")) for i, t, w in ((1, "THE", who[0]), (2, "", who[1]), (3, "que", who[0]))]
    questions = spark.range(1).select(F.explode(F.array(*asked)).alias("q")).select("q.*")
    return memory.search(fx.memory(spark, sf_dir).withColumns(scope), questions, stamp(NOW)).select("query_id", "conv_id", "turn", "owner_id", "kind")


@query(f"""WITH {fx.DECISIONS}, w AS (SELECT decision_id, ['public', 'internal', 'confidential', 'tlp:amber', 'tlp:red'] AS lv, classification, namespace_id, actor, decision_id % 4 AS w FROM f_decisions),
d AS (SELECT *, CASE WHEN [4, 2, 4, 4][1 + w] < list_position(lv, classification) - 1 THEN 'CLASSIFICATION_DENIED' WHEN w <> 1 AND CAST(substr(namespace_id, 4) AS INTEGER) >= 20 THEN 'NAMESPACE_DENIED' WHEN w = 2 THEN 'ACTION_DENIED' END AS a,
  CASE WHEN c.c_custkey IS NULL THEN 'EVIDENCE_NOT_FOUND' WHEN [4, 2, 4, 4][1 + w] < c.c_nationkey % 5 THEN 'CLASSIFICATION_DENIED' END AS b FROM w LEFT JOIN customer c ON c.c_custkey = actor AND c.c_acctbal > 0)
SELECT decision_id AS request_id, CASE WHEN a IS NULL AND b IS NULL THEN 'recorded' ELSE concat_ws(',', a, b) END AS state FROM d""")
def recorded_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome of every decision, told by one of four writers with a customer in credit for evidence: recorded, or refused for the writer's access to the decision, for evidence that isn't there, or that the writer may not read."""
    spaces = [f"ns-{i}" for i in range(25)]
    who = [access.reader("w0", "t", spaces[:20], "tlp:red", ["editor"]), access.reader("w1", "t", spaces, "confidential", ["editor"]), access.reader("w2", "t", spaces[:20], "tlp:red", ["viewer"]), access.reader("w3", "t", spaces[:20], "tlp:red", ["admin", "viewer"])]
    d = fx.decisions(spark, sf_dir).withColumns({"tenant_id": F.lit("t"), "visibility": F.lit("workspace")})
    rows = d.select(F.col("decision_id").alias("request_id"), "decision_id", F.get(F.array(*who), F.pmod("decision_id", F.lit(4)).cast("int")).alias("writer"), F.lit("done").alias("outcome"), F.array("actor").alias("evidence_ids"))
    proof = fx.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("evidence_id"), F.lit("t").alias("tenant_id"), F.lit("ns-0").alias("namespace_id"), F.get(F.lit(CLASSIFICATIONS), F.col("c_nationkey").cast("int") % 5).alias("classification"), F.lit("workspace").alias("visibility"))
    made = write_access.record_facts(rows, "outcome", d, stamp(NOW), proof)
    return made["records"].select("request_id", F.lit("recorded").alias("state")).unionByName(made["rejected"].select("request_id", F.array_join("errors", ",").alias("state")))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(fx.table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


BOUNDS = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500]


@query(f"SELECT event_type, {', '.join(f'count(*) FILTER (value <= {b}) AS le_{b}' for b in BOUNDS)}, round(sum(value), 4) AS sum, count(value) AS count FROM events GROUP BY event_type")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(fx.table(spark, sf_dir, "events"), ["event_type"], "value", BOUNDS).withColumn("sum", F.round("sum", 4))


@query("""SELECT event_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(concat(event_type, ':', CAST(user_id AS VARCHAR)), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: CAST((CAST(xor(h, c) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT)) / 42949672.96::DOUBLE < 10 AS sampled FROM events""")
def stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    return fx.table(spark, sf_dir, "events").select("event_id", (T.stable_sample(key) < 10).alias("sampled"))


@query("""SELECT event_type, count(*) AS left_count, count(*) FILTER (value >= 5) AS right_count, count(*) = count(*) FILTER (value >= 5) AS equal FROM events GROUP BY event_type""")
def dataset_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return evaluate.parity(e, e.where("value >= 5"), ["event_type"])


_LAST = f"""WITH {fx.EVENTS}, last AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY occurred_at DESC, event_id DESC) AS n FROM f_events WHERE kind IN ('claim.asserted', 'claim.retracted') AND claim_id IS NOT NULL)
SELECT claim_id, event_id FROM last WHERE n = 1 AND kind = 'claim.asserted'"""


@query(_LAST)
def projection_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.rebuild(fx.event_log(fx.table(spark, sf_dir, "events"))).select("claim_id", "event_id")


@query(_LAST)
def projection_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.sync(spark, f"{sf_dir}/events.parquet", projection.scratch(spark)).select("claim_id", "event_id")


_CONTENT = f"""WITH RECURSIVE {fx.EVENTS.strip()}, {fx.PROJECTED.strip()}, e AS (SELECT *, {_emb('text', 8)} AS r FROM f_projected)
SELECT claim_id, concat('e:', s) AS canonical_subject, CASE WHEN claim_id % 3 = 0 THEN concat('e:', o) END AS canonical_object, text, array_to_string(list_transform(r, lambda x: printf('%.6f', round(x / sqrt(list_sum(list_transform(r, lambda y: y * y))), 6) + 0.0)), ',') AS vector FROM e"""


def _shown_content(rows: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("vector", lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0)), ",")
    return rows.select("claim_id", "canonical_subject", "canonical_object", "text", shown.alias("vector"))


@query(_CONTENT)
def projection_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.merge_log(fx.table(spark, sf_dir, "events"))
    return _shown_content(projection.content(fx.projected_claims(spark, sf_dir), log, lambda t: T.hash_embedding(t, 8)))


@query(_CONTENT)
def projection_content_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = projection.sync_content(spark, f"{sf_dir}/events.parquet", projection.scratch(spark), lambda session: fx.projected_claims(session, sf_dir), lambda t: T.hash_embedding(t, 8), fx.merge_log)
    return _shown_content(kept)


@query(f"""WITH {fx.EVENTS}, r AS (SELECT * FROM f_events WHERE kind IN ('claim.asserted', 'claim.retracted')), p AS (SELECT * FROM r WHERE event_id % 10 = 9)
SELECT (SELECT count(*) FROM p) AS pending, (SELECT strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') FROM r) AS latest_event, (SELECT (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(max(occurred_at))) // 1000 FROM p) AS lag_ms, TRUE AS stale, FALSE AS ready""")
def projection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.event_log(fx.table(spark, sf_dir, "events"))
    s = projection.status(e, e.where("event_id % 10 <> 9"), stamp("2030-01-01 00:00:00"))
    return s.select("pending", F.date_format("latest_event", "yyyy-MM-dd HH:mm:ss").alias("latest_event"), "lag_ms", "stale", "ready")


@query(f"WITH {fx.EVENTS} SELECT event_id, kind FROM f_events WHERE event_id % 3 <> 0")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.event_log(fx.table(spark, sf_dir, "events"))
    return sinks.outbox(e, e.where("event_id % 3 = 0").select("event_id")).select("event_id", "kind")


# Records, lifecycle and extensions

@query("""SELECT 'customer' AS k, c_mktsegment AS label, count(*) AS n, sha256(concat('entity', chr(1), 'local', chr(1), 'default', chr(1), lower(trim(c_mktsegment)))) AS entity_id FROM customer GROUP BY c_mktsegment""")
def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer").select(F.lit("local").alias("tenant_id"), F.lit("default").alias("namespace_id"), F.col("c_mktsegment").alias("label"), F.array("c_name").alias("aliases"))
    counts = records.entity_names(c).where("source = 'alias'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return records.entities(c).join(counts, "entity_id").select(F.lit("customer").alias("k"), "label", "n", "entity_id")


@query("""WITH r AS (SELECT l_orderkey AS from_id, l_partkey AS to_id FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY ALL), e AS (SELECT from_id AS decision_id, 'from' AS role FROM r UNION ALL SELECT to_id, 'to' FROM r)
SELECT decision_id, role, count(*) AS n FROM e JOIN orders ON o_orderkey = decision_id GROUP BY ALL""")
def decision_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem")
    tasks = -(-lines.count() // lifecycle.ROWS) or 1  # not by bytes: pairs of numbers are packed so well that a task of 64 MB has very many
    pairs = lines.select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id")).where("from_id <> to_id").repartition(tasks, "from_id", "to_id").distinct()
    log = records.events(pairs.withColumn("relation_id", records.make_id("relation", F.col("from_id"), F.col("to_id"))), lifecycle.KINDS["relation"], "relation_id", stamp(NOW))
    seen = lifecycle.facts(log, "relation", "relation_id string, from_id long, to_id long")
    return lifecycle.relations_of(fx.decisions(spark, sf_dir), seen, 2 * tasks).groupBy("decision_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT DISTINCT d.o_orderkey AS decision_id, e.event_id FROM orders d JOIN events e ON e.user_id = d.o_orderkey UNION SELECT DISTINCT o.o_orderkey, e.event_id FROM orders o JOIN events e ON e.user_id = o.o_custkey)
SELECT decision_id, count(*) AS n FROM e GROUP BY decision_id""")
def decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").cast("string").alias("claim_id"))
    e = fx.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("subject_id"))
    proof = d.select("decision_id", F.lit(None).cast("string").alias("evidence_id"))
    return lifecycle.touching(d, e, d, proof).groupBy("decision_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS proposal_id, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'SAME_ENTITY' END, CASE WHEN (c_custkey % 5 = 0 AND c_custkey >= 5 AND c_custkey % 35 <> 0) OR (c_custkey + (c_custkey % 4) > 4 AND (c_custkey + c_custkey % 4) % 5 = 0 AND (c_custkey + c_custkey % 4) % 35 <> 0 AND c_custkey + c_custkey % 4 <= (SELECT max(c_custkey) FROM customer)) THEN 'NOT_CANONICAL' END,
  CASE WHEN c_custkey % 6 = 1 THEN 'EQUIVALENT_PROPOSAL' END, CASE WHEN c_custkey % 9 = 0 THEN 'SIGNAL_REQUIRED' END], lambda x: x IS NOT NULL), ',') AS errors FROM customer""")
def proposal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = fx.table(spark, sf_dir, "customer").select(k.alias("proposal_id"), k.alias("source_id"), (k + k % 4).alias("candidate_id"), F.when(k % 9 == 0, 0).otherwise(2).alias("n_signals"))
    earlier = p.where("proposal_id % 6 = 1").select("source_id", "candidate_id", F.lit("open").alias("state"))
    return lifecycle.proposal_errors(p, earlier, identity.roots(fx.merges(spark, sf_dir))).select("proposal_id", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {_LEX}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS rank FROM lex0) WHERE rank <= 10)
SELECT query_id, claim_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY claim_id DESC) AS INTEGER) AS place FROM top""")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir)
    hits = search.lexical_top_k(asked, _texts(spark, sf_dir), 10).join(asked.withColumnRenamed("text", "query"), "query_id")
    order = extension.reranking(lambda q, ids: sorted(ids, reverse=True))(hits)
    return fusion.rerank(hits, order).select("query_id", "claim_id", "place")
