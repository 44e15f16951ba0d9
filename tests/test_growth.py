"""What grows with the tables: spread over tasks, work per case, results on odd inputs."""

import itertools
import re
import tracemalloc
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimstead.functions import text as T
from claimstead.operators import decisions, identity, lexical_index, lifecycle, policy, search, temporal, vector_graph
from claimstead.plans import fixtures as fx
from claimstead.plans import registry

POLICY = "policy_id string, version long, status string, effective_from timestamp_ntz, effective_to timestamp_ntz, purposes array<string>, namespace_ids array<string>, classifications array<string>, min_confidence double, allowed_outcomes array<string>, max_classification string"
DAY = [datetime(2020, 1, d) for d in range(1, 29)]


@pytest.fixture(scope="module")
def policies(spark):
    lists = [None, ["a"], ["a", "b"], []]
    spans = [(None, None), (DAY[2], DAY[4]), (DAY[3], None), (None, DAY[5])]
    rows = [(None if i == 5 else f"p{i % 3}", i, "draft" if i % 7 == 6 else "active", *span, p, n, c, 0.5, ["F"], "internal") for i, (p, n, c, span) in enumerate(itertools.product(lists, lists[:3], lists[:2], spans))]
    return spark.createDataFrame(rows, POLICY)


@pytest.fixture(scope="module")
def decided(spark):
    values = [None, "a", "b", "c"]
    rows = [(i, p, n, c, at, (i % 10) / 10, "FO"[i % 2]) for i, (p, n, c, at) in enumerate(itertools.product(values, values, values[:3], [None, DAY[2], DAY[3], DAY[20]]))]
    return spark.createDataFrame(rows, "decision_id long, purpose string, namespace_id string, classification string, recorded_at timestamp_ntz, confidence double, selected_outcome string")


def test_policies_by_scope_and_by_lists_are_those_of_the_rule(decided, policies, monkeypatch):
    rule = policy.applicable(F.col("policy"), F.col("purpose"), F.col("namespace_id"), F.col("classification"), F.col("recorded_at"))
    want = sorted(map(tuple, decided.crossJoin(policies.select(F.struct("*").alias("policy"))).where(rule).select("decision_id", "policy.version").collect()))
    got = lambda: sorted(map(tuple, policy.applicable_policies(decided, policies).select("decision_id", "policy.version").collect()))
    assert got() == want and want
    monkeypatch.setattr(policy, "SCOPES", 3)
    assert got() == want


def test_decisions_in_one_piece_are_dealt_before_they_meet_candidates(decided, policies):
    found = policy.what_if(decided.coalesce(1), policies.where("version < 4"))
    assert found.rdd.getNumPartitions() > 1 and found.count() == 4 * decided.count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_violations_of_pairs_are_those_of_the_rule_as_list_and_as_text(decided, policies):
    rows = decided.crossJoin(policies.select(F.struct("*").alias("policy")))
    rule = policy.violations(F.col("policy"), F.col("confidence"), F.col("selected_outcome"), F.col("classification"))
    want = sorted((r[0], r[1], tuple(r[2])) for r in rows.select("decision_id", "policy.version", rule).collect())
    found, text = policy.what_if(decided, policies), policy.what_if(decided, policies, joined="; ")
    assert sorted((r["decision_id"], r["version"], tuple(r["violations"])) for r in found.collect()) == want
    assert sorted((r["decision_id"], r["version"], r["violations"]) for r in text.collect()) == sorted((d, v, "; ".join(x)) for d, v, x in want)
    assert "lambda" not in plan_of(found) and all(r["would_fail"] == bool(r["violations"]) for r in text.collect())
    meet = {(r[0], r[1]) for r in policy.applicable_policies(decided, policies).select("decision_id", "policy.version").collect()}
    judged = policy.evaluate(decided, policies, joined="; ")
    assert sorted((r["decision_id"], r["version"], r["violations"]) for r in judged.collect()) == sorted((d, v, "; ".join(x)) for d, v, x in want if (d, v) in meet)
    assert all(r["compliant"] == (not r["violations"]) for r in judged.collect())


def test_a_decision_is_looked_up_once_for_all_short_windows_and_once_for_open_ones(spark, decided, policies):
    short = [("p", 100 + n, "active", DAY[1], DAY[1 + n], None, None, None, 0.5, ["F"], "internal") for n in (1, 2, 4, 8, 15, 25)]
    every = policies.union(spark.createDataFrame(short, POLICY))
    (cells,) = [line for line in plan_of(policy.evaluate(decided, every)).splitlines() if "explode(CASE WHEN isnotnull(recorded_at" in line]
    assert cells.count("shiftright") == 1


def test_only_wanted_fields_of_policies_are_shuffled(decided, policies):
    found = policy.applicable_policies(decided, policies, ["version"])
    assert found.schema["policy"].dataType.names == ["version"]
    laid = re.findall(r"\[([^\[\]]*)\], false, \[_cell#", plan_of(found))
    assert laid and "_p_version" in laid[0] and not re.search("purposes|namespace_ids|classifications|allowed", laid[0])
    every = policy.applicable_policies(decided, policies)
    assert sorted(found.select("decision_id", "policy.version").collect()) == sorted(every.select("decision_id", "policy.version").collect())


def test_policies_folded_for_a_decision_are_those_it_meets_as_pairs(spark, decided, policies, monkeypatch):
    more = [("p", 200, "active", datetime(1990, 1, 1), DAY[0], None, None, None, 0.5, ["F"], "internal"), ("p", 201, "active", DAY[27], None, None, None, None, 0.5, ["F"], "internal"), ("p", 202, "active", DAY[2], DAY[2], None, None, None, 0.5, ["F"], "internal")]
    every = policies.union(policies.where("version < 20")).union(spark.createDataFrame(more, POLICY)).repartition(3)
    pairs, item = policy.applicable_policies(decided, every), F.to_json(F.struct("version", "policy_id"))
    rows = pairs.select("decision_id", F.struct("policy.version", "policy.policy_id").alias("p")).groupBy("decision_id").agg(F.sort_array(F.collect_set("p")).alias("p"))
    want = {r[0]: (r[1], r[2], r[3]) for r in rows.select("decision_id", F.size("p"), F.sha2(F.to_json("p"), 256), F.array_join(F.transform("p", lambda x: x["version"].cast("string")), ",")).collect()}
    assert len(want) > 100
    got = lambda item, order, fold, rows=decided: {r[0]: (r["n"], r["folded"]) for r in policy.folded_policies(rows, every, item, order, fold, ["decision_id"]).collect()}
    met = policy.folded_policies(decided, every, item, ["version", "policy_id"], "sha256", ["decision_id"])
    assert not re.search(r"Join.*_until", plan_of(met))
    one = decided.where("purpose = 'a' AND namespace_id = 'a' AND classification = 'a'")
    few = {r["decision_id"] for r in one.collect()}
    for scopes in (5000, 3):
        monkeypatch.setattr(policy, "SCOPES", scopes)
        assert got(item, ["version", "policy_id"], "sha256") == {r["decision_id"]: want.get(r["decision_id"], (0,))[:2] for r in decided.collect()}
        assert {k: v[0] for k, v in got(item, ["version"], None).items()} == {k: v[0] for k, v in want.items()}
        text = {k: v[1] for k, v in got(F.lpad(F.col("version").cast("string"), 3, "0"), None, "joined", one).items()}
        assert text == {k: ",".join(f"{int(v):03}" for v in want[k][2].split(",")) for k in few}


def test_groups_of_policies_go_on_over_batches_and_results_are_handed_on_in_parts(monkeypatch):
    us = pa.timestamp("us")
    row = lambda of, asks, since, until, item, k: {"_of": of, "_range": 0, "_asks": asks, "_since": since, "_until": until, "_item": item, "_k_id": k}
    rows = [row(1, 0, 5, 9, "a", None), row(1, 0, None, 7, "b", None), row(1, 0, 6, None, "b", None), row(1, 1, None, None, None, 1), row(1, 1, 5, None, None, 2), row(1, 1, 6, None, None, 3), row(1, 1, 6, None, None, 4), row(1, 1, 9, None, None, 5), row(2, 1, 6, None, None, 6), row(3, 0, 1, 2, "c", None)]
    schema = pa.schema([("_of", pa.int64()), ("_range", pa.int32()), ("_asks", pa.int32()), ("_since", us), ("_until", us), ("_item", pa.string()), ("_k_id", pa.int64())])
    want = [(1, 2, "a,b"), (2, 2, "a,b"), (3, 2, "a,b"), (4, 2, "a,b"), (5, 1, "b"), (6, 0, "")]
    for size, held, together in ((1, 16, 64), (3, 1, 1), (10, 4, 2), (10, 16_000_000, 64)):
        monkeypatch.setattr(policy, "HELD_BYTES", held)
        monkeypatch.setattr(policy, "TOGETHER", together)
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema) for i in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in policy._folds(policy.FOLDS["joined"], ["id"])(iter(batches)) for r in b.to_pylist()] == want


def test_replay_where_policies_are_met_is_that_of_references(spark, decided, policies, monkeypatch):
    asked = decided.withColumn("snapshot_id", F.concat(F.lit("s"), F.col("decision_id") % 3))
    kept, receipts = spark.sql("SELECT 's0' AS snapshot_id, 'r0' AS receipt_id UNION ALL SELECT 's1', 'r1'"), spark.sql("SELECT 'r0' AS receipt_id")
    known, doubled = policies.where("version % 3 = 0").select("policy_id", "version"), policies.union(policies.where("version > 10"))
    key = lambda df: sorted(map(tuple, df.collect()))
    refs = lambda some: policy.applicable_policies(asked, some).select("decision_id", "policy.policy_id", "policy.version")
    want = key(decisions.replay(asked, refs(doubled), known, kept, receipts))
    assert any(m.count("@") > 2 and m.endswith("receipt:r1") for _, _, m in want)
    told = decisions.replay_applicable(asked, doubled, known, kept, receipts)
    assert key(told) == want and not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*MapInArrow", plan_of(told))
    assert key(decisions.replay_applicable(asked, doubled, known)) == key(decisions.replay(asked, refs(doubled), known))
    real = doubled.where("policy_id IS NOT NULL")
    whole = key(decisions.replay_applicable(asked, real, real, kept))
    assert whole == key(decisions.replay(asked, refs(real), real, kept)) and {done for _, done, _ in whole} == {True, False}
    monkeypatch.setattr(policy, "SCOPES", 3)
    assert key(decisions.replay_applicable(asked, doubled, known, kept, receipts)) == want


def test_sections_of_one_frame_and_folded_ones_are_those_of_their_rows(spark, decided, policies):
    shape = lambda rows, schema: spark.createDataFrame(rows, schema)
    versions = shape([(7, DAY[1], 1, "asserted"), (7, DAY[1], 1, "asserted")], "claim_id long, recorded_at timestamp_ntz, version_seq int, status string")
    linked = decided.select("decision_id", F.explode(F.lit([7, 7, 0]).cast("array<long>")).alias("claim_id"))
    # an event of a claim that is the decision too, one without an id, one told of two claims
    log = shape([(1, 7, "k"), (2, 0, "k"), (None, 7, "j"), (3, 7, "k"), (3, 0, "k"), (4, None, "k")], "event_id long, claim_id long, kind string")
    lines = decided.select("decision_id", F.explode(F.lit([3, 1, 3, 2]).cast("array<long>")).alias("x"), F.col("purpose").alias("y"))
    odd = F.when((F.col("x") % 2 == 1) & (F.col("decision_id") > 5), F.struct("x", "y"))
    item = F.to_json(F.struct("version", "policy_id"))
    folded = policy.folded_policies(decided, policies, item, ["version", "policy_id"], "sha256", ["decision_id"])
    key = lambda df: sorted((r["decision_id"], *map(repr, r[1:])) for r in df.collect())
    told = decisions.audit(decided, linked, versions, log, {"policy_versions": folded, "relations": (lines, F.struct("x")), "evidence": (lines, odd)})
    plain = {"policy_versions": policy.applicable_policies(decided, policies).select("decision_id", "policy.version", "policy.policy_id"), "relations": lines.select("decision_id", "x"), "evidence": lines.where("x % 2 = 1 AND decision_id > 5").select("decision_id", "x", "y")}
    assert key(told) == key(decisions.audit(decided, linked, versions, log, plain))
    first = told.where("decision_id = 3").first()
    assert (first["n_claims"], first["n_events"], first["n_relations"], first["n_evidence"]) == (1, 4, 3, 0)


def test_tally_is_counted_once_a_case(spark, decided, policies):
    twice = decided.union(decided.withColumn("decision_id", F.col("decision_id") + 1000))
    assert policy.cases(twice, policy.SCOPE + policy.JUDGED)[1].count() <= decided.count()
    near = spark.createDataFrame([(1, datetime(2020, 1, 1, 0, 0, 0, 1)), (2, datetime(2020, 1, 1, 0, 0, 0, 2)), (3, None), (4, None)], "decision_id long, recorded_at timestamp_ntz")
    assert policy.cases(near, policy.SCOPE)[1].count() == 3
    per = policy.evaluate(twice, policies).groupBy("decision_id").agg(F.count(F.lit(1)).alias("evaluated"), F.sum(F.when(F.col("compliant"), 0).otherwise(1)).alias("violated"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(policy.tally(twice, policies)) == key(per)


def test_sections_and_references_of_a_case_are_those_of_its_decisions(spark, decided, policies):
    named, each = policy.cases(decided, policy.SCOPE)
    shape = lambda rows, schema: spark.createDataFrame(rows, schema)
    # versions at the very instant count, the later of two at one instant holds, retracted ones and decisions without an instant don't
    versions = shape([(7, DAY[1], 1, "asserted"), (7, DAY[2], 1, "conflicted"), (7, DAY[2], 2, "asserted"), (8, DAY[1], 1, "asserted"), (8, DAY[3], 1, "retracted"), (9, None, 1, "asserted")], "claim_id long, recorded_at timestamp_ntz, version_seq int, status string")
    linked = decided.select("decision_id", F.explode(F.lit([7, 8, 9, 7]).cast("array<long>")).alias("claim_id"))
    log = shape([(1, 7, "k"), (2, 0, "k")], "event_id long, claim_id long, kind string")
    refs = lambda df, key: policy.applicable_policies(df, policies).select(key, "policy.version", "policy.policy_id")
    key = lambda df: sorted((r["decision_id"], *map(repr, r[1:])) for r in df.collect())
    told = decisions.audit(named, linked, versions, log, {"policy_versions": refs(each, "case_id")})
    assert key(told) == key(decisions.audit(decided, linked, versions, log, {"policy_versions": refs(decided, "decision_id")}))
    n = {r["decision_id"]: r["n_claims"] for r in told.collect()}
    assert [n[i] for i in range(4)] == [0, 2, 1, 1]
    known = policies.where("version % 2 = 0").select("policy_id", "version")
    assert key(decisions.replay(named, refs(each, "case_id"), known)) == key(decisions.replay(decided, refs(decided, "decision_id"), known))


def test_many_entities_of_one_name_do_not_multiply(spark, monkeypatch):
    names = spark.range(400).select(F.col("id").alias("entity_id"), F.when(F.col("id") % 2 == 0, "red fox").otherwise("red fox den").alias("name"), F.lit("label").alias("source"), F.col("id").alias("canonical_id"))
    asked = spark.range(10).select(F.col("id").alias("query_id"), F.lit("red fox").alias("name"), F.col("id").alias("own"))
    same = spark.range(300).select(F.lit(3).cast("long").alias("query_id"), (F.col("id") + 7).alias("canonical_id"), F.lit("x").alias("value"))
    sizes, settle = [], identity.settle
    monkeypatch.setattr(identity, "settle", lambda df: (lambda kept: sizes.append(kept.count()) or kept)(settle(df)))
    found = identity.candidates(asked, names, external=same)
    got = {q: [(r["entity_id"], r["kind"], len(r["signals"])) for r in sorted(rows, key=lambda r: r["place"])] for q, rows in ((q, [r for r in found.collect() if r["query_id"] == q]) for q in (0, 3))}
    assert got[0] == [(i, "label-exact", 1) for i in (2, 4, 6, 8, 10)]
    assert got[3] == [(0, "label-exact", 1), (2, "label-exact", 1), (4, "label-exact", 1), (6, "label-exact", 1), (7, "external-id-exact", 2)]
    assert max(sizes) <= 200


def test_every_part_is_asked_for_its_candidates(spark, sf_dir):
    asked = registry.er_candidates(spark, sf_dir).select("query_id").distinct().count()
    assert asked == fx.table(spark, sf_dir, "part").count()


def test_queries_of_the_same_names_are_answered_once(spark, monkeypatch):
    names = spark.createDataFrame([(1, "red fox"), (2, "red fox den"), (3, "blue")], "entity_id long, name string").withColumns({"source": F.lit("label"), "canonical_id": F.col("entity_id")})
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit("red fox"), F.lit("blue"))).otherwise(F.array(F.lit("red fox")))).alias("name"))
    sizes, settle = [], identity.settle
    monkeypatch.setattr(identity, "settle", lambda df: (lambda kept: sizes.append(kept.count()) or kept)(settle(df)))
    got = {(r["query_id"], r["entity_id"], r["kind"], r["place"]) for r in identity.candidates(asked, names).collect()}
    both = [(1, "label-exact", 1), (3, "label-exact", 2), (2, "partial-token-overlap", 3)]
    assert got == {(q, *row) for q in range(300) for row in (both if q % 3 == 0 else [both[0], (2, "partial-token-overlap", 2)])}
    assert max(sizes) < 20


def test_runs_of_all_texts_are_found_at_once(spark):
    """Bytes of a whole segment, cut between texts; signs whose lower case has a letter, nulls and a slice."""
    texts = ["skipped", "Ab1 c-ab1", "ab1", None, "", "\u212aELVIN \u0130x \u00c9t\u00e9 stra\u00dfe", "--", "a", "b"]
    runs, number, place = lexical_index._runs(pa.array(texts)[1:])
    want = Counter((r, i) for i, t in enumerate(spark.createDataFrame([(i, t) for i, t in enumerate(texts[1:])], "i int, t string").selectExpr("lower(t)").collect()) for r in re.findall("[a-z0-9]+", t[0] or ""))
    assert Counter(zip((runs.to_pylist()[n] for n in number), place.tolist(), strict=True)) == want and runs.to_pylist() == sorted({r for r, _ in want})
    assert len(lexical_index._runs(pa.array([None, ""], pa.string()))[0]) == 0 and len(lexical_index._runs(pa.array([], pa.string()))[0]) == 0


def test_index_of_many_texts_equals_scan_while_runs_are_forgotten(spark, monkeypatch):
    """Segments of more than one word of bits; a task remembers few runs."""
    monkeypatch.setattr(lexical_index, "MEMORY", 3)
    texts = spark.range(300).select(F.col("id").alias("claim_id"), F.concat_ws(" ", F.concat(F.lit("run"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id"))).alias("text"))
    asked = spark.createDataFrame([(1, "run1 x2 run1"), (2, "un x29 zz"), (3, "-"), (4, "zz")], "query_id long, text string").withColumn("terms", F.array("text"))
    index, key = identity.settle(lexical_index.segments(texts, per_segment=100)), lambda df: sorted(map(tuple, df.select("query_id", "claim_id", "score", "rank").collect()))
    assert key(lexical_index.lexical_top_k(asked, index, 5)) == key(search.lexical_top_k(asked, texts, 5)) and max(len(r["claim_ids"]) for r in index.collect()) > 64
    some = asked.withColumn("terms", F.split("text", " "))
    pick = lambda df: sorted(map(tuple, df.select("query_id", "claim_id", "rank").collect()))
    assert pick(lexical_index.full_text_or(some, index, 50)) == pick(search.full_text_or(some, texts, 50))


def test_embedding_reads_characters_in_numpy(spark):
    """Sums of codes are those of plain Python, also past the first table of places and outside the first plane; the plan has no function per character."""
    texts = ["", "a", "Éa\U0001f600b", "xy" * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["s0"], r["s1"]) for r in df.where("t IS NOT NULL").select("i", T.code_sums(F.col("t")).alias("s")).select("i", "s.*").collect()}
    assert got == {i: (sum(map(ord, t)), sum(ord(c) * n for n, c in enumerate(t))) for i, t in enumerate(texts) if t is not None}
    vectors = df.select("i", T.hash_embedding(F.col("t"), 4).alias("v"))
    assert {r["i"]: r["v"] for r in vectors.collect()}[4] == [None] * 4 and "split(" not in vectors._jdf.queryExecution().toString()


def test_vectors_are_held_against_in_small_tables(spark):
    """A graph's table of products is a slice of its shard's, and lists of slices are those of the whole."""
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(2000, 8))
    tracemalloc.start()
    vector_graph.neighbours(unit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    scores, ids = np.round(rng.normal(size=(6, 900)), 1), rng.permutation(900)
    scores[5] = -9.0
    best = search.Nearest(6, 7, -2.0)
    for at in range(0, 900, 50):
        best.add(ids[at : at + 50], scores[:, at : at + 50])
    got = sorted(tuple(r.values()) for batch in best.rows(list(range(6))) for r in batch.to_pylist())
    assert got == sorted((i, int(ids[j]), float(scores[i, j])) for i in range(5) for j in np.lexsort((ids, -scores[i]))[:7])


def test_versions_count_once_however_many_instants(spark):
    """Instants in any order, twice and null; versions at an instant, after the last, without time; the plan has no row per version and instant."""
    versions = spark.createDataFrame([("a", DAY[1], 1, "x"), ("a", DAY[3], 2, "y"), ("a", DAY[3], 3, None), ("a", DAY[9], 4, "z"), ("b", DAY[6], 1, "x"), ("c", None, 1, "x"), ("d", DAY[9], 1, "x")], "claim_id string, recorded_at timestamp_ntz, version_seq int, status string")
    instants = [F.lit(d).cast("timestamp_ntz") for d in (DAY[6], DAY[0], DAY[3], DAY[6], None, DAY[4])]
    found = temporal.known_at_each(versions, instants)
    assert found.columns == ["known_at", "claim_id", "recorded_at", "version_seq", "status"]
    assert sorted((r["known_at"], r["claim_id"], r["version_seq"]) for r in found.collect()) == [(DAY[3], "a", 3), (DAY[4], "a", 3), (DAY[6], "a", 3), (DAY[6], "b", 1)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]


def test_ends_of_relations_are_dealt_by_their_number(spark):
    seen = spark.range(1000).select(F.col("id").cast("string").alias("relation_id"), (F.col("id") % 90).alias("from_id"), (F.col("id") % 70).alias("to_id"))
    known = spark.range(80).withColumnRenamed("id", "decision_id")
    key = lambda df: sorted(map(tuple, df.select("decision_id", "relation_id", "role").collect()))
    dealt = lifecycle.relations_of(known, seen, 23)
    assert key(dealt) == key(lifecycle.relations_of(known, seen)) and dealt.rdd.getNumPartitions() == 23


def test_or_reads_no_more_of_the_index_than_it_needs(spark, tmp_path):
    """Postings are bytes as narrow as their numbers; frequencies aren't read; several segments in a task, questions with many, few and no texts."""
    for values in ([], [0, 255], [3, 256], [70_000, 0], [1 << 31]):
        packed = lexical_index._packed(np.array(values, np.int64))
        assert lexical_index._unpacked(packed, len(values)).tolist() == values and len(packed) == len(values) * (1 if max(values, default=0) < 256 else 2 if max(values) < 65_536 else 4)
    texts = spark.range(400).select(F.col("id").alias("claim_id"), F.when(F.col("id") % 50 != 7, F.concat_ws(" ", F.concat(F.lit("run"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id")))).alias("text"))
    lexical_index.write(texts.coalesce(1), f"{tmp_path}/i", per_segment=20)
    asked = spark.createDataFrame([(1, ["run1", "run2"]), (2, ["x390", "x4", "zz"]), (3, ["zz"]), (4, []), (5, ["run6"])], "query_id long, terms array<string>")
    pick = lambda df: sorted(map(tuple, df.select("query_id", "claim_id", "rank").collect()))
    for questions in (asked, asked.where("query_id IN (1, 5)")):
        found = lexical_index.full_text_or(questions, lexical_index.read(spark, f"{tmp_path}/i").coalesce(1), 5)
        assert pick(found) == pick(search.full_text_or(questions, texts, 5))
        scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line and "claim_ids" in line]
        assert scans and all("places:binary" in line and "tf:" not in line and "most:" not in line for line in scans)


def test_tokens_of_any_length_are_found_in_all_runs_at_once(monkeypatch):
    """Short terms by tables, long ones by the automaton; at both ends of a run and of the text, never over a blank; a term twice in a run counts once; only one kind, or none, of terms."""
    runs = ["0", "aa", "aaa", "abc", "abcabc", "abcde", "bc", "bcdeabcd", "c", "zzzzzzzz"]
    packed = {"claim_ids": [[1]], "runs": [" ".join(runs)], **{c: [lexical_index._packed(np.array(v))] for c, v in (("counts", [1] * 10), ("places", [0] * 10))}}
    segment = lexical_index.Segment(pa.RecordBatch.from_pydict(packed), 0)
    assert segment.runs.to_pylist() == runs
    for terms in (["a", "aa", "abc", "abcd", "abcde", "bcdea", "ca", "zzzz", "zzzzz"], ["abcde", "zzzzz"], ["bc"], ["qq", "qqqqqq"], []):
        for memory in (100_000, 3):
            monkeypatch.setattr(lexical_index, "MEMORY", memory)
            number, run = segment.holding(lexical_index.Within(terms))
            assert list(zip(number.tolist(), run.tolist(), strict=True)) == [(i, j) for i, t in enumerate(terms) for j, r in enumerate(runs) if t in r]
    empty = lexical_index.Segment(pa.RecordBatch.from_pydict({**packed, "runs": [""], "counts": [b""], "places": [b""]}), 0)
    assert len(empty.runs) == 0 and len(empty.holding(lexical_index.Within(["ab"]))[0]) == 0


def test_a_search_runs_once_for_a_snapshot(spark):
    """Snapshots and contexts need hits twice, or three times; rows of the search are counted."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    hits = spark.createDataFrame([(1, 10, 1, "r1"), (1, 11, 2, "r1"), (2, 11, 1, "r2")], "query_id long, claim_id long, rank int, receipt_id string").mapInArrow(count, "query_id long, claim_id long, rank int, receipt_id string")
    evidence = spark.createDataFrame([(10, "e2"), (11, "e1"), (11, "e2")], "claim_id long, evidence_id string")
    got = decisions.snapshots(hits, evidence).collect()
    assert {r["query_id"]: (r["claim_ids"], r["evidence_ids"]) for r in got} == {1: ([10, 11], ["e2", "e1"]), 2: ([11], ["e1", "e2"])} and seen.value == 3
    requests = spark.createDataFrame([(1, "audit")], "query_id long, purpose string")
    policies = spark.createDataFrame([(1, "p", 2)], "query_id long, policy_id string, version int")
    assert decisions.context(requests, hits, evidence, policies, 5, F.lit(DAY[0])).collect()[0]["receipt_id"] == "r1" and seen.value == 6
