"""Small fixtures with exact expected values, and random models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from claimstead.functions import text as T
from claimstead.functions.temporal import overlaps, stamp, valid_at
from claimstead.operators import access, conflicts, contracts, evaluate, fusion, graph, identity, policy, search, temporal, validation
from claimstead.sources import files, sinks
from claimstead.streaming import projection


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_intervals_are_half_open(spark):
    a, b, c = (stamp(f"2024-01-0{i} 00:00:00") for i in (1, 2, 3))
    assert not one(spark, overlaps(a, b, b, c)) and one(spark, overlaps(a, F.lit(None).cast("timestamp_ntz"), b, c))
    assert one(spark, valid_at(a, b, a)) and not one(spark, valid_at(a, b, b)) and one(spark, valid_at(a, b, F.lit(None).cast("timestamp_ntz")))


def test_names(spark):
    assert one(spark, T.normal_name(F.lit("ＡＣＭＥ　株式会社"))) == "acme 株式会社"
    sig = lambda q, c, s="label": one(spark, T.name_signal(F.lit(q), F.lit(c), F.lit(s)))
    assert sig("acme", "acme")["score"] == 1.0 and sig("acme", "acme", "alias")["kind"] == "alias-exact"
    assert sig("a b c d", "a b c d e")["kind"] == "strong-token-overlap" and sig("a b", "a c b")["kind"] == "partial-token-overlap"
    assert sig("acm", "acme corp x")["kind"] == "substring" and sig("zz", "acme") is None and sig("", "x") is None


def test_tokens_and_scores(spark):
    assert one(spark, T.lexical_tokens(F.lit("Vendor X, vendor-9z"))) == ["vendor", "vendor", "9z"]
    assert one(spark, T.lexical_score(T.lexical_tokens(F.lit("vendor vendor")), F.lit("AVendors"))) == 2
    assert one(spark, T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0)))) == 1.0 and one(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0.0


def test_hash_embedding_and_sample_follow_their_definitions(spark):
    import math

    text = "alice is_ceo_of"
    raw = [math.sin(sum(ord(c) * (d + 1 + i) for i, c in enumerate(text))) for d in range(5)]
    want = [x / math.sqrt(sum(y * y for y in raw)) for x in raw]
    assert one(spark, T.hash_embedding(F.lit(text), 5)) == pytest.approx(want, abs=1e-12)
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    assert one(spark, T.stable_sample(F.lit(text))) == pytest.approx(h / 42949672.96)
    assert one(spark, T.stable_sample(F.lit(""))) == pytest.approx(2166136261 / 42949672.96)


def test_policy_keys(spark):
    assert tuple(one(spark, T.parse_policy_key(F.lit("a@b@-3")))) == ("a@b", -3) and one(spark, T.parse_policy_key(F.lit("a@x"))) is None


def test_as_of_join_against_a_model(spark):
    rng = random.Random(1)
    versions = [(rng.randrange(5), rng.randrange(20), i, f"s{i}") for i in range(60)]
    probes = [(i, rng.randrange(7), rng.randrange(-1, 22)) for i in range(40)]
    got = temporal.as_of_join(spark.createDataFrame(probes, "p int, k int, at int"), spark.createDataFrame(versions, "k int, t int, seq int, v string"), "k", "at", ["t", "seq"])
    found = {r["p"]: r["v"] for r in got.collect()}
    for p, k, at in probes:
        past = [v for v in versions if v[0] == k and v[1] <= at]
        assert found[p] == (max(past, key=lambda v: (v[1], v[2]))[3] if past else None)


def claim(i, s, p, o, a, b, status="asserted"):
    t = lambda d: None if d is None else f"2024-01-{d:02d} 00:00:00"
    return ("t", "n", s, p, i, o, t(a), t(b), status, "internal", "workspace")


def claims_of(spark, rows):
    df = spark.createDataFrame(rows, "tenant_id string, namespace_id string, subject_id string, predicate string, claim_id string, object_value string, f string, u string, status string, classification string, visibility string")
    return df.withColumns({"valid_from": F.col("f").cast("timestamp_ntz"), "valid_to": F.col("u").cast("timestamp_ntz")})


def rules_of(spark, n):
    return spark.createDataFrame([("legalName", ["legalName", "name"], n)], "rule_id string, terms array<string>, max int")


def test_cardinality_conflicts(spark):
    sets = lambda rows, n: sorted(tuple(r["claim_ids"]) for r in conflicts.detect(claims_of(spark, rows), rules_of(spark, n)).collect())
    assert sets([claim("a", "s", "name", "A", 1, None), claim("b", "s", "legalName", "B", 1, None)], 1) == [("a", "b")]
    assert sets([claim("a", "s", "name", "A", 1, 5), claim("b", "s", "name", "B", 5, 9)], 1) == []
    assert sets([claim(i, "s", "name", i, 1, None) for i in "abc"], 2) == [("a", "b", "c")]
    assert sets([claim("a", "s", "name", "A", 1, None), claim("b", "s", "name", "B", 1, None, "retracted")], 1) == []


def test_cardinality_conflicts_against_a_model(spark):
    rng = random.Random(3)
    rows = [claim(f"c{i:02d}", f"s{rng.randrange(3)}", "name", f"o{rng.randrange(4)}", a := rng.randrange(1, 15), rng.choice([None, a + rng.randrange(1, 9)])) for i in range(30)]
    want = set()
    for s in {r[2] for r in rows}:
        own, sets = [r for r in rows if r[2] == s], set()
        day = lambda x: 99 if x is None else int(x[8:10])
        for at in {day(r[6]) for r in own}:
            best = {}
            for r in own:
                if day(r[6]) <= at < day(r[7]):
                    best[r[5]] = min(best.get(r[5], "z"), r[4])
            if len(best) > 1:
                sets.add(frozenset(best.values()))
        want |= {tuple(sorted(x)) for x in sets if not any(x < y for y in sets)}
    assert {tuple(r["claim_ids"]) for r in conflicts.detect(claims_of(spark, rows), rules_of(spark, 1)).collect()} == want


def test_overlap_pairs_never_join_equal_objects(spark):
    rng = random.Random(5)
    rows = [claim(f"c{i:02d}", f"s{rng.randrange(2)}", "p", f"o{rng.randrange(2)}", a := rng.randrange(1, 15), rng.choice([None, a + 3])) for i in range(25)]
    by = {r[4]: r for r in rows}
    got = {(r["left_id"], r["right_id"]) for r in temporal.overlap_pairs(claims_of(spark, rows)).collect()}
    day = lambda x: 99 if x is None else int(x[8:10])
    want = {(x, y) for x in by for y in by if x < y and by[x][2] == by[y][2] and by[x][5] != by[y][5] and day(by[x][6]) < day(by[y][7]) and day(by[y][6]) < day(by[x][7])}
    assert got == want


def test_access_never_crosses_tenants_or_clearance(spark):
    rows = spark.createDataFrame([(t, "n1", c, v, o) for t in ("t1", "t2") for c in ("public", "tlp:red", None) for v in ("private", "public") for o in ("me", "you", None)], "tenant_id string, namespace_id string, classification string, visibility string, owner_id string")
    me = access.reader("me", "t1", ["n1"], "internal", ["viewer"])
    for r in access.reasons(rows, [me], "knowledge.read", stamp("2024-01-01 00:00:00")).collect():
        want = "CROSS_TENANT_DENIED" if r["tenant_id"] != "t1" else "CLASSIFICATION_DENIED" if r["classification"] != "public" else "VISIBILITY_DENIED" if r["visibility"] == "private" and r["owner_id"] == "you" else "ALLOW"
        assert r["reason"] == want
    written = access.reasons(rows.where("tenant_id = 't1' AND classification = 'public' AND visibility = 'public'"), [me], "memory.write", stamp("2024-01-01 00:00:00"))
    assert {r["reason"] for r in written.collect()} == {"ACTION_DENIED"}


def test_expired_or_missing_delegation_is_denied(spark):
    rows = spark.createDataFrame([("t1", "n1", "public", "public", "x")], "tenant_id string, namespace_id string, classification string, visibility string, owner_id string")
    agent = access.reader("bot", "t1", ["n1"], "internal", [], "agent", "me")
    reason = lambda given, now: access.reasons(rows, [agent], "knowledge.read", stamp(now), "audit", given).first()["reason"]
    good = access.delegation("me", ["knowledge.read"], "2024-06-01 00:00:00", "audit")
    assert reason(good, "2024-01-01 00:00:00") == "ALLOW" and reason(good, "2024-07-01 00:00:00") == "DELEGATION_DENIED" and reason(None, "2024-01-01 00:00:00") == "DELEGATION_DENIED"
    assert reason(access.delegation("me", ["knowledge.read"], "2024-06-01 00:00:00", "other"), "2024-01-01 00:00:00") == "DELEGATION_DENIED"


def merges_of(spark, rows):
    return spark.createDataFrame(rows, "absorbed_id long, surviving_id long, reverted boolean, event_seq long")


def test_roots_against_a_chain_walk(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(i), rng.random() < 0.2, i) for i in range(1, 60)]
    to = {a: s for a, s, r, _ in rows if not r}
    for r in identity.roots(merges_of(spark, rows)).collect():
        x = r["entity_id"]
        while x in to:
            x = to[x]
        assert x == r["canonical_id"]


def test_merge_cycles(spark):
    rows = merges_of(spark, [(1, 2, False, 1), (2, 3, False, 2), (3, 2, False, 3), (5, 6, False, 4)])
    with pytest.raises(ValueError):
        identity.roots(rows)
    assert {r["entity_id"]: r["canonical_id"] for r in identity.roots(rows, "stop").collect()} == {1: 2, 5: 6}


def test_external_ids_match_after_normalisation(spark):
    a = spark.createDataFrame([(1, "CRM", " C-0042 ")], "query_id int, s string, v string").select("query_id", T.normal_external(F.col("s"), F.col("v")).alias("x")).select("query_id", "x.*")
    b = spark.createDataFrame([("e", "crm", "C-0042")], "entity_id string, s string, v string").select("entity_id", T.normal_external(F.col("s"), F.col("v")).alias("x")).select("entity_id", "x.*")
    assert [tuple(r) for r in identity.external_matches(a, b).collect()] == [(1, "e", 1.0)]


def test_fusion_prefers_what_both_lists_have(spark):
    lists = spark.createDataFrame([(1, "lexical", "a", 1), (1, "lexical", "b", 2), (1, "vector", "b", 1), (1, "vector", "c", 2)], "query_id int, strategy string, claim_id string, rank int")
    top = fusion.reciprocal_rank_fuse(lists).orderBy(F.desc("score")).first()
    assert top["claim_id"] == "b" and top["lexical_component"] == pytest.approx(1 / 62) and top["vector_component"] == pytest.approx(1 / 61)


def test_retrieval_metrics(spark):
    got = spark.createDataFrame([("q1", "a", 1), ("q1", "x", 2), ("q1", "b", 3), ("q2", "x", 1), ("q2", "c", 2)], "query_id string, claim_id string, rank int")
    rel = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c")], "query_id string, claim_id string")
    m = evaluate.retrieval_metrics(got, rel, rel.select("query_id").distinct(), 2).first()
    assert tuple(m) == (2, 0.5, 0.75, 1.0, 0.75)
    assert tuple(evaluate.retrieval_metrics(got, rel, rel.where("false"), 2).first()) == (0, 0, 0, 0, 0)


def test_graph_reaches_two_hops_and_cycles_end(spark):
    edges = spark.createDataFrame([("x", "a", "b"), ("y", "b", "c"), ("z", "c", "a"), ("w", "d", "e")], "claim_id string, subject_id string, object_entity_id string")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, entity string")
    assert {r["claim_id"]: r["hop"] for r in graph.graph_hits(seeds, edges, 5).collect()} == {"x": 1, "z": 1, "y": 2}


def test_cyclic_types_and_closure(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "e")], "type_id string, parent_id string")
    assert sorted(r[0] for r in graph.cyclic_types(parents).collect()) == ["a", "b", "c"]
    closed = {tuple(r) for r in graph.type_closure(parents.where("type_id IN ('a', 'd')")).collect()}
    assert closed == {("a", "a"), ("a", "b"), ("b", "b"), ("d", "d"), ("d", "e"), ("e", "e")}


def test_policy_versions_and_violations(spark):
    p = policy.policy("p", 2, 0.5, ["yes"], "internal", ["loan"], "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    fits = lambda purpose, at: one(spark, policy.applicable(p, F.lit(purpose), F.lit(None).cast("string"), F.lit(None).cast("string"), stamp(at)))
    assert fits("loan", "2024-01-01 00:00:00") and not fits("loan", "2024-02-01 00:00:00") and not fits("car", "2024-01-05 00:00:00")
    assert one(spark, policy.violations(p, F.lit(0.1), F.lit("no"), F.lit("tlp:red"))) == ["confidence below 0.5", "outcome no is not allowed", "classification exceeds internal"]
    assert one(spark, policy.violations(p, F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == []


def test_datatypes(spark):
    fits = lambda v, t: one(spark, contracts.matches_datatype(F.lit(v), F.lit(t)))
    assert fits("12", "integer") and not fits("1.5", "integer") and not fits("99999999999999999", "integer") and fits("1e3", "number") and not fits("1d", "number")
    assert fits("true", "boolean") and not fits("TRUE", "boolean") and fits("2024-02-29", "date") and not fits("2024-02-30", "date") and fits("https://a.b/c", "uri") and not fits("x", "integer")


def test_validation_codes(spark):
    good = validation.claim_errors(F.lit("c"), F.lit(0.5), stamp("2024-01-01 00:00:00"), F.lit(None).cast("timestamp_ntz"), F.array(F.lit("e")), F.struct(F.lit("a").alias("source"), F.lit("b").alias("actor"), F.lit("c").alias("process"), F.lit("2024-01-01T00:00:00Z").alias("timestamp")))
    bad = validation.claim_errors(F.lit(" "), F.lit(float("nan")), stamp("2024-01-02 00:00:00"), stamp("2024-01-01 00:00:00"), F.array().cast("array<string>"), F.lit(None).cast("struct<source:string,actor:string,process:string,timestamp:string>"))
    assert one(spark, good) == [] and one(spark, bad) == ["BLANK_ID", "CONFIDENCE_RANGE", "INVALID_INTERVAL", "EVIDENCE_REQUIRED", "PROVENANCE_REQUIRED"]
    assert one(spark, validation.hidden_reasoning(F.lit('{"hiddenCoT": "x"}'))) and not one(spark, validation.hidden_reasoning(F.lit('{"a": 1}')))


def test_lexical_search_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc1") for _ in range(rng.randrange(1, 6)))
    texts = [(i, " ".join(word() for _ in range(8)) + rng.choice(["", "!", "É"])) for i in range(30)]
    asked = [(i, " ".join(word() for _ in range(4))) for i in range(10)]
    got = {(r["query_id"], r["claim_id"]): r["score"] for r in search.lexical_top_k(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(texts, "claim_id int, text string"), 100).collect()}
    want = {(q, c): n for q, a in asked for c, t in texts if (n := sum(x in t.lower() for x in a.split() if len(x) > 1))}
    assert got == want


def test_files_and_inline_requests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("hello")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.txt").write_text("no")
    found = {r["path"]: (r["text"], r["mime"]) for r in files.decoded(files.files(spark, str(tmp_path))).collect()}
    assert found == {"a/n.md": ("hello", "text/markdown")}
    bodies = spark.createDataFrame([('{"documents":[{"path":"p","text":"t"},{"path":"q"}]}',), ('{"text":"u"}',)], "body string")
    assert sorted(tuple(r) for r in files.inline_documents(bodies).collect()) == [("p", "t", "text/plain"), ("untitled.txt", "u", "text/plain")]


def test_retraction_is_visible_only_after_it(spark):
    v = spark.createDataFrame([("c", "asserted", "2024-01-01 00:00:00", 1)], "claim_id string, status string, r string, version_seq int").select("claim_id", "status", F.col("r").cast("timestamp_ntz").alias("recorded_at"), "version_seq")
    all_ = sinks.put_versions(v, sinks.retract(v, v.select("claim_id"), stamp("2024-01-01 00:00:01")))
    seen = {str(r["known_at"])[-2:]: r["status"] for r in temporal.known_at_each(all_, [stamp("2024-01-01 00:00:00"), stamp("2024-01-01 00:00:01")]).collect()}
    assert seen == {"00": "asserted", "01": "retracted"}
    assert sinks.retract(all_, v.select("claim_id"), stamp("2024-01-02 00:00:00")).count() == 0


def test_projection_batches_are_idempotent_and_order_free(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 4, "claim.asserted" if i % 3 else "claim.retracted") for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, t string, claim_id long, kind string").select("event_id", F.col("t").cast("timestamp_ntz").alias("occurred_at"), "claim_id", "kind", F.lit(0.0).alias("value"))
    merge = projection.merge_batch(f"file://{tmp_path}/s")
    merge(e.where("event_id % 2 = 1"), 0)
    merge(e.where("event_id % 2 = 0"), 1)
    merge(e.where("event_id % 2 = 0"), 1)
    key = lambda df: sorted(map(tuple, df.select("claim_id", "event_id").collect()))
    assert key(projection.state(spark, f"file://{tmp_path}/s").where("kind = 'claim.asserted'")) == key(projection.rebuild(e))


def test_vector_blocks_give_one_result(spark):
    rng = random.Random(13)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)], "claim_id long, vector array<double>")
    q = v.where("claim_id % 3 = 0").withColumnRenamed("claim_id", "query_id")
    key = lambda df: sorted(map(tuple, df.select("query_id", "claim_id", "rank").collect()))
    whole = key(search.vector_top_k(q, v, 5))
    assert whole == key(search.vector_top_k(q, v, 5, block=4)) and len(whole) == 5 * q.count()
