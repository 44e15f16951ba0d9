"""Guards, recorded decisions, entity objects, graph leg, projections and other parts with exact expected values on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from claimstead.functions import text as T
from claimstead.functions.temporal import stamp
from claimstead.operators import access, conflicts, contracts, decisions, evaluate, extension, extract, fusion, graph, identity, lifecycle, policy, records, search, temporal, validation
from claimstead.plans import retrieval
from claimstead.sources import files, sinks
from claimstead.streaming import projection


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_long_chains_of_types_hold_no_cycle(spark):
    chain = [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(300)]
    assert graph.cyclic_types(spark.createDataFrame(chain, "type_id string, parent_id string")).count() == 0
    looped = graph.cyclic_types(spark.createDataFrame([*chain, ("t300", "t295")], "type_id string, parent_id string"))
    assert looped.count() == 301


def test_merge_cycles_raise_soon(spark):
    ring = [(i, (i + 1) % 5, False, i) for i in range(5)]
    with pytest.raises(ValueError, match="cycle"):
        identity.roots(spark.createDataFrame(ring, "absorbed_id long, surviving_id long, reverted boolean, event_seq long"))


def test_candidates_equal_brute_force(spark):
    rng = random.Random(21)
    pool = ["al", "a", "alice", "corp", "alice corp", "bo", "bob ltd", "ltd", "al corp", "corporation"]
    names = [(i, rng.choice(pool) + (f" {rng.choice(pool)}" if rng.random() < 0.4 else ""), rng.choice(["label", "alias"])) for i in range(60)]
    asked = [(1000 + i, n) for i, n in enumerate(["alice corp", "al", "bob ltd co", "corp", "zz"])]

    def signal(q, c, source):
        if q == c:
            return 1.0 if source == "label" else 0.92
        a, b = set(q.split()), set(c.split())
        j = len(a & b) / len(a | b)
        return 0.82 if j >= 0.8 else 0.68 if j >= 0.5 else 0.58 if len(q) >= 3 and (q in c or c in q) else 0

    frame = spark.createDataFrame([(i, n, s, i // 2) for i, n, s in names], "entity_id long, name string, source string, canonical_id long")
    got = {(r["query_id"], r["entity_id"]): r for r in identity.candidates(spark.createDataFrame(asked, "query_id long, name string"), frame, limit=1000).collect()}
    want = {}
    for q, n in asked:
        for i, c, s in names:
            if x := signal(n, c, s):
                want[q, i // 2] = max(want.get((q, i // 2), 0), x)
    assert {k: r["score"] for k, r in got.items()} == want
    assert all(r["signals"][0]["score"] == r["score"] and len(set(r["signals"])) == len(r["signals"]) for r in got.values())
    own = spark.createDataFrame([(1000, "alice corp", k) for k in range(30)], "query_id long, name string, own long")
    assert identity.candidates(own, frame).count() == 0
    outside = spark.createDataFrame([(1004, 29, "x9")], "query_id long, canonical_id long, value string")
    found = identity.candidates(spark.createDataFrame([(1004, "zz")], "query_id long, name string"), frame, external=outside).collect()
    assert [(r["entity_id"], r["kind"], r["score"]) for r in found] == [(29, "external-id-exact", 1.0)]


def test_rejected_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [nan, 0.0]), (4, None), (5, [inf, 1.0]), (6, [0.0, 2.0]), (7, [1.0, None])], "claim_id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert rows(search.vector_top_k(q, v, 10), "claim_id", "score") == [(1, 1.0), (6, 0.0)]
    good, bad = search.checked_vectors(v, 2)
    assert rows(good, "claim_id") == [(1,), (6,)] and rows(bad, "claim_id", "fault") == [(2, "VECTOR_WIDTH"), (3, "VECTOR_NOT_FINITE"), (4, "VECTOR_MISSING"), (5, "VECTOR_NOT_FINITE"), (7, "VECTOR_NOT_FINITE")]
    with pytest.raises(ValueError, match="VECTOR_WIDTH"):
        search.vector_top_k(spark.createDataFrame([(9, [1.0, 0.0]), (8, [1.0])], "query_id long, vector array<double>"), v, 10)


def test_empty_question_gives_the_first_texts(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["b c", None, "", "ab", "zz"])], "claim_id int, text string")
    asked = spark.createDataFrame([(1, "!"), (2, "ab zz"), (3, None)], "query_id int, text string")
    assert rows(search.lexical_top_k(asked, texts, 3), "query_id", "claim_id", "score") == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 3, 1), (2, 4, 1), (3, 0, 0), (3, 1, 0), (3, 2, 0)]
    assert rows(search.lexical_top_k(asked, texts, 3, block=1), "query_id", "claim_id", "score") == rows(search.lexical_top_k(asked, texts, 3), "query_id", "claim_id", "score")


def test_reasons_and_fusion(spark):
    null = F.lit(None).cast("double")
    assert one(spark, T.explain_hit(F.lit(24.0), null, null)) == "lexical 24" and one(spark, T.explain_hit(F.lit(2.0), F.lit(0.531), F.lit(0.3))) == "lexical 2; vector 0.53; graph neighborhood" and one(spark, T.explain_hit(null, null, null)) == "metadata match"
    lists = spark.createDataFrame([(1, "lexical", 7, 1, None), (1, "lexical", 7, 3, None), (1, "graph", 7, 2, "e1"), (1, "vector", 7, 5, None)], "query_id int, strategy string, claim_id int, rank int, route string")
    r = fusion.reciprocal_rank_fuse(lists).first()
    assert r["lexical_component"] == pytest.approx(1 / 63) and r["score"] == pytest.approx(1 / 61 + 1 / 63 + 1 / 62 + 1 / 65) and r["route"] == "e1"
    hits = spark.createDataFrame([(1, 5, 0.5, "a"), (1, 5, 0.9, "b"), (2, 5, 0.1, "c")], "query_id int, claim_id int, score double, via string")
    assert rows(fusion.merge_best(hits), "query_id", "via") == [(1, "b"), (2, "c")]


CLAIM = "claim_id string, subject_id string, predicate string, object_value string, object_entity_id string, object_datatype string, f string, u string"


def claims_of(spark, data):
    df = spark.createDataFrame(data, CLAIM).withColumns({c: F.lit(v) for c, v in {"tenant_id": "t", "namespace_id": "n", "status": "asserted"}.items()})
    return df.withColumns({"valid_from": F.col("f").cast("timestamp_ntz"), "valid_to": F.col("u").cast("timestamp_ntz"), "recorded_at": F.col("f").cast("timestamp_ntz")})


def test_entities_and_literals_as_objects(spark):
    day = "2024-01-0{} 00:00:00".format
    data = [("a", "s", "boss", None, "e1", None, day(1), None), ("b", "s", "boss", None, "e2", None, day(2), None), ("c", "s", "boss", "e1", None, None, day(3), None), ("d", "s2", "boss", None, "e1", None, day(1), None), ("e", "s2", "boss", None, "e3", None, day(2), None)]
    claims = claims_of(spark, data)
    merged = spark.createDataFrame([("e3", "e1"), ("s2", "s2b")], "entity_id string, canonical_id string")
    assert rows(temporal.overlap_pairs(claims), "left_id", "right_id") == [("a", "b"), ("a", "c"), ("b", "c"), ("d", "e")]
    assert rows(temporal.later_conflicts(claims).where("status = 'conflicted'"), "claim_id") == [("b",), ("c",), ("e",)]
    assert rows(temporal.later_conflicts(claims, merged).where("status = 'conflicted'"), "claim_id") == [("b",), ("c",)]
    rule = spark.createDataFrame([("boss", ["boss"], 1)], "rule_id string, terms array<string>, max int")
    assert rows(conflicts.detect(claims, rule), "subject_id", "claim_ids") == [("s", ["a", "b", "c"]), ("s2", ["d", "e"])]
    assert rows(conflicts.detect(claims, rule, merged), "subject_id", "claim_ids") == [("s", ["a", "b", "c"])]
    typed = claims_of(spark, [("a", "s", "p", "1", None, "int", day(1), None), ("b", "s", "p", "1", None, None, day(2), None)])
    assert rows(temporal.overlap_pairs(typed), "left_id", "right_id") == [("a", "b")]


def test_later_conflicts_against_a_model(spark):
    rng = random.Random(23)
    data = [(f"c{i:02d}", f"s{rng.randrange(3)}", "p", rng.choice(["x", "y", "z", None]), None, None, f"2024-01-{rng.randrange(1, 9):02d} 00:00:00", None) for i in range(60)]
    got = {r["claim_id"]: r["status"] for r in temporal.later_conflicts(claims_of(spark, data)).collect()}
    for c in data:
        clash = any(d[1] == c[1] and (d[6], d[0]) < (c[6], c[0]) and d[3] is not None and d[3] != c[3] for d in data) and c[3] is not None
        assert got[c[0]] == ("conflicted" if clash else "asserted")
    resolved = spark.createDataFrame([("x",)], "conflict_id string")
    assert conflicts.not_recorded(spark.createDataFrame([("x",), ("y",)], "conflict_id string"), resolved).first()["conflict_id"] == "y"


def test_percentiles_against_sorting(spark):
    rng = random.Random(24)
    data = [(g, v) for g in ("a", "b", None) for v in [rng.choice([rng.gauss(0, 1e3), 5.0, -2.5, 1e9]) for _ in range(rng.randrange(1, 400))]] + [("one", 3.0), ("none", None)]
    got = {r["g"]: (r["p50"], r["p95"]) for r in evaluate.percentiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", bins=8).collect()}
    for g in ("a", "b", None, "one"):
        own = sorted(v for k, v in data if k == g)
        assert got[g] == tuple(own[max(1, -int(-len(own) * p // 1)) - 1] for p in (0.5, 0.95))
    assert "none" not in got


def test_graph_leg_of_both_retrievals(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "delta"), (4, "eps"), (5, "far")], "claim_id long, text string")
    vectors = texts.select("claim_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector")).where("claim_id > 100")
    edges = spark.createDataFrame([(1, "A", "B"), (2, "B", "C"), (3, "C", "D"), (4, "D", None), (5, "Z", "Y")], "claim_id long, subject_id string, object_entity_id string")
    asked = spark.createDataFrame([(9, "alpha", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    plan = retrieval.Plan()
    added = {r["claim_id"]: r for r in retrieval.additive(asked, texts, vectors, plan, edges).collect()}
    assert {c: round(r["score"], 3) for c, r in added.items()} == {1: 1.0, 2: 0.3, 3: 0.15} and added[3]["route"] == "C" and added[1]["graph"] is None
    fused = {r["claim_id"]: r for r in retrieval.fused(asked, texts, vectors, plan, edges).collect()}
    assert set(fused) == {1, 2, 3} and fused[2]["graph_component"] == pytest.approx(1 / 61) and fused[3]["graph_component"] == pytest.approx(1 / 62) and fused[2]["route"] == "B"
    assert retrieval.candidates("graph", asked, texts, vectors, edges, spark.createDataFrame([(9, "A")], "query_id long, entity string"), plan).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        retrieval.candidates("other", asked, texts, vectors, None, None, plan)


def test_review_and_merge_guards(spark):
    proposals = spark.createDataFrame([("p1", "a", "b"), ("p2", "c", "d"), ("p3", "e", "f")], "proposal_id string, source_id string, candidate_id string").withColumns({"tenant_id": F.lit("t"), "namespace_id": F.lit("n")})
    reviews = spark.createDataFrame([("p1", 1, "approve", "ok"), ("p2", 1, "reject", "no"), ("p3", 1, "approve", "ok"), ("p3", 2, "approve", " ")], "proposal_id string, decided_seq int, outcome string, reason string")
    merges = spark.createDataFrame([("p3", "m3", False), ("p9", "m9", True)], "proposal_id string, merge_id string, reverted boolean")
    asked = spark.createDataFrame([(1, "p1", "a"), (2, "p1", "b"), (3, "p2", "c"), (4, "p3", "z"), (5, "p7", "a")], "request_id int, proposal_id string, surviving_id string")
    assert rows(lifecycle.merge_guard(asked, proposals, reviews, merges), "request_id", "errors") == [(1, []), (2, ["ALREADY_MERGED"]), (3, ["NOT_APPROVED"]), (4, ["SURVIVOR_OUTSIDE_PAIR", "ALREADY_MERGED"]), (5, ["UNKNOWN_PROPOSAL"])]
    undo = spark.createDataFrame([(1, "m3", "wrong"), (2, "m3", "again"), (3, "m9", ""), (4, "m0", "x")], "request_id int, merge_id string, reason string")
    assert rows(lifecycle.revert_guard(undo, merges), "request_id", "errors") == [(1, []), (2, ["ALREADY_REVERTED"]), (3, ["ALREADY_REVERTED", "REASON_REQUIRED"]), (4, ["UNKNOWN_MERGE"])]
    assert rows(lifecycle.review_errors(reviews), "proposal_id", "decided_seq", "errors")[-1] == ("p3", 2, ["ALREADY_DECIDED", "REASON_REQUIRED"])
    assert rows(lifecycle.proposals_of(proposals, "t", "n", "d"), "proposal_id") == [("p2",)] and lifecycle.proposals_of(proposals, "t").count() == 3
    known = spark.createDataFrame([("k", ["a", "b"])], "conflict_id string, claim_ids array<string>")
    choice = spark.createDataFrame([(1, "k", ["b", "a"], "a"), (2, "k", ["a", "z"], "q"), (3, "x", ["a", "b"], "a")], "resolution_id int, conflict_id string, claim_ids array<string>, preferred_claim_id string")
    live = spark.createDataFrame([("a",), ("b",)], "claim_id string")
    assert rows(lifecycle.resolution_guard(choice, known, known.where("false"), live), "resolution_id", "errors") == [(1, []), (2, ["CLAIM_SET_DIFFERS", "PREFERRED_OUTSIDE", "UNKNOWN_CLAIM"]), (3, ["UNKNOWN_CONFLICT"])]


def test_accepted_requests_have_events_and_others_are_rejected(spark):
    at = stamp("2024-01-01 00:00:00")
    proposals = spark.createDataFrame([("p1", "a", "b"), ("p2", "c", "d")], "proposal_id string, source_id string, candidate_id string")
    reviews = spark.createDataFrame([("p1", 1, "approve", "same"), ("p1", 2, "reject", "late"), ("p2", 1, "approve", "")], "proposal_id string, decided_seq int, outcome string, reason string")
    made = lifecycle.applied(reviews, lifecycle.review_errors(reviews), ["proposal_id", "decided_seq"], "entity.resolution_decided", at)
    assert rows(made["accepted"], "proposal_id", "decided_seq") == [("p1", 1)] and rows(made["rejected"], "proposal_id", "errors") == [("p1", ["ALREADY_DECIDED"]), ("p2", ["REASON_REQUIRED"])]
    asked = spark.createDataFrame([(1, "p1", "a"), (2, "p2", "c")], "request_id int, proposal_id string, surviving_id string")
    none = spark.createDataFrame([], "proposal_id string, merge_id string, reverted boolean")
    merged = lifecycle.applied(asked, lifecycle.merge_guard(asked, proposals, made["accepted"], none), ["request_id"], "entity.merged", at)
    assert rows(merged["accepted"], "proposal_id") == [("p1",)] and rows(merged["events"], "kind") == [("entity.merged",)] and merged["outbox"].count() == 1
    state = identity.resolution_state(proposals, made["accepted"], merged["accepted"].select("proposal_id", F.lit(False).alias("reverted")))
    assert rows(state, "proposal_id", "state") == [("p1", "merged"), ("p2", "open")]
    facts = spark.createDataFrame([("d1", "good")], "decision_id string, outcome string")
    log = lifecycle.recorded_facts(facts, "outcome", at)
    assert rows(lifecycle.facts(log, "outcome", "decision_id string, outcome string"), "decision_id", "outcome") == [("d1", "good")]
    kept = records.memories(spark.createDataFrame([("me", "note", "x")] * 2, "owner_id string, kind string, body string"), at)
    assert kept.select("memory_id").distinct().count() == 1


def test_validation_of_other_records(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, validation.merge_errors(F.lit("a"), empty)) == ["ABSORBED_REQUIRED"] and one(spark, validation.merge_errors(F.lit("a"), F.array(F.lit("a")))) == ["SURVIVOR_ABSORBED"]
    assert one(spark, validation.resolution_errors(F.array(F.lit("a")), F.lit("b"))) == ["TWO_CLAIMS_REQUIRED", "PREFERRED_OUTSIDE"]
    assert one(spark, validation.policy_errors(stamp("2024-01-02 00:00:00"), stamp("2024-01-02 00:00:00"))) == ["INVALID_EFFECTIVE_WINDOW"]
    rules = spark.createDataFrame([("r1", ["a", "b"], 1), ("r2", ["b"], 0)], "rule_id string, terms array<string>, max int")
    assert rows(validation.rule_errors(rules), "term", "code") == [("b", "MAX_NOT_POSITIVE"), ("b", "TERM_IN_TWO_RULES")]
    scoped = spark.createDataFrame([(1, "t", "n"), (1, "t", "m"), (2, "t", "n")], "g int, tenant_id string, namespace_id string")
    assert rows(validation.one_scope(scoped, "g"), "g", "one_scope") == [(1, False), (2, True)]
    held = spark.createDataFrame([(1, ["a", "z"])], "g int, ids array<string>")
    assert rows(validation.missing_references(held, "ids", spark.createDataFrame([("a",)], "id string"), "id"), "reference") == [("z",)]
    assert one(spark, validation.snapshot_errors(F.lit(""), F.lit('{"hiddenCoT": 1}'))) == ["CONTEXT_SNAPSHOT_REQUIRED", "HIDDEN_REASONING"]
    assert [one(spark, validation.bad_instant(F.lit(v))) for v in ("soon", "2024-01-01", None)] == [True, False, True]


def test_contexts_and_recorded_decisions(spark):
    asked = spark.createDataFrame([(1, "loan", None), (2, "car", "which car"), (3, "x", " ")], "query_id long, purpose string, query string")
    assert rows(decisions.question_of(asked), "query_id", "question") == [(1, "loan"), (2, "which car"), (3, "x")]
    hits = spark.createDataFrame([(1, 10, 1, "r1"), (1, 11, 2, "r1"), (1, 12, 3, "r1"), (2, 10, 1, "r2")], "query_id long, claim_id long, rank int, receipt_id string")
    proof = spark.createDataFrame([(10, "e2"), (11, "e1"), (11, "e2"), (12, "e9")], "claim_id long, evidence_id string")
    refs = spark.createDataFrame([(1, "p", 2)], "query_id long, policy_id string, version int")
    built = decisions.context(asked, hits, proof, refs, 2, stamp("2024-01-01 00:00:00"))
    by = {r["query_id"]: r for r in built.collect()}
    assert by[1]["claim_ids"] == [10, 11] and by[1]["evidence_ids"] == ["e2", "e1"] and by[1]["receipt_id"] == "r1" and [tuple(x) for x in by[1]["policy_refs"]] == [("p", 2)] and by[1]["budget"] == 2
    assert by[3]["claim_ids"] == [] and by[3]["policy_refs"] == [] and len({r["snapshot_id"] for r in by.values()}) == 3
    requests = spark.createDataFrame([(1, 1, "me", "loan", "yes", 0.4, "{}"), (2, 1, "me", "loan", "no", 0.9, '{"hiddenCoT": 1}'), (3, 77, "me", "loan", "no", 0.9, "{}")], "request_id long, query_id long, actor string, purpose string, selected_outcome string, confidence double, payload string")
    made = decisions.record(requests, built, [policy.policy("p", 2, 0.5, purposes=["loan"])], stamp("2024-01-01 00:00:00"))
    assert rows(made["decisions"], "request_id", "considered_evidence_ids") == [(1, ["e2", "e1"])] and rows(made["evaluations"], "compliant", "violations") == [(False, ["confidence below 0.5"])]
    assert rows(made["rejected"], "request_id", "errors") == [(2, ["HIDDEN_REASONING"]), (3, ["CONTEXT_SNAPSHOT_REQUIRED"])] and rows(made["events"], "kind") == [("decision.recorded",)] and made["outbox"].count() == 1


def test_reads_are_answered_or_refused(spark):
    held = spark.createDataFrame([("a", "t", "n1", "public"), ("b", "t", "n2", "public"), ("c", "t", "n1", "tlp:red"), ("d", "u", "n1", "public")], "id string, tenant_id string, namespace_id string, classification string").withColumns({"visibility": F.lit("workspace"), "owner_id": F.lit("x")})
    me = access.reader("me", "t", ["n1", "n3"], "internal", ["viewer"])
    good, refused = access.read_or_reject(held, me, "knowledge.read", stamp("2024-01-01 00:00:00"))
    assert rows(good, "id") == [("a",)] and rows(refused, "id", "reason") == [("b", "NAMESPACE_DENIED"), ("c", "CLASSIFICATION_DENIED"), ("d", "CROSS_TENANT_DENIED")]
    assert [r["id"] for r in access.in_namespaces(held, me, "id").collect()] == ["a", "c"]
    with pytest.raises(Exception, match="access denied"):
        access.assert_allowed(access.reasons(held, [me], "knowledge.read", stamp("2024-01-01 00:00:00"))).collect()
    decided = spark.createDataFrame([(1, "ALLOW"), (1, "DENIED"), (2, "ALLOW")], "g int, reason string")
    assert rows(access.all_members_allowed(decided, "g"), "g", "allowed") == [(1, False), (2, True)]
    twice = access.receipts(good.withColumns({"principal_id": F.lit("me"), "reason": F.lit("ALLOW")}), "knowledge.read", "claim", "id", stamp("2024-01-01 00:00:00"))
    later = twice.withColumns({"evaluated_at": stamp("2024-01-02 00:00:00"), "effect": F.lit("deny")})
    assert rows(access.unique_receipts(twice.union(later)), "resource_id", "effect") == [("a", "deny")]


def test_contract_parts(spark):
    none = F.array().cast("array<string>")
    types = spark.createDataFrame([("A", "urn:a", ["x"]), ("B", "urn:a", ["x", "y"])], "id string, iri string, aliases array<string>")
    rule = F.array().cast("array<struct<kind:string,pattern:string,length:int>>")
    predicates = spark.createDataFrame([("p", "active", 2), ("q", "draft", 1)], "id string, status string, max_count int").withColumns({"domain": F.array(F.lit("A")), "range_types": none, "rules": rule, "min_count": F.lit(1), "iri": F.lit(None).cast("string"), "aliases": none, "position": F.lit(1)})
    parents = spark.createDataFrame([("B", "A")], "type_id string, parent_id string")
    assert rows(contracts.lint(types, parents, predicates, graph.cyclic_types(parents)), "code", "path") == [("DUPLICATE_ALIAS", "x"), ("DUPLICATE_IRI", "urn:a")]
    assert rows(contracts.conflict_rules(predicates, "c@1"), "rule_id", "terms", "source") == [("p", ["p"], "semantic-contract:c@1")]
    entities = spark.createDataFrame([("e1", "B"), ("e2", "C")], "entity_id string, type_id string")
    said = spark.createDataFrame([("e1", "p"), ("e1", "zz"), ("e2", "zz")], "subject_id string, predicate string")
    closed = spark.createDataFrame([("B",)], "type_id string")
    assert rows(contracts.closed_types(said, entities, graph.type_closure(parents), predicates, closed), "entity_id", "predicate") == [("e1", "zz")]
    bodies = spark.createDataFrame([("k", 1, "a", "active"), ("k", 1, "b", "active"), ("m", 1, "a", "active"), ("m", 2, "c", "active"), ("m", 3, "d", "draft")], "id string, version int, body string, status string")
    assert rows(contracts.changed_bodies(bodies), "id", "version") == [("k", 1)] and ("m", 2, "c") in rows(contracts.latest_active(bodies), "id", "version", "body")
    assert one(spark, T.term_iri(F.lit(None).cast("string"), F.lit("urn:"), F.lit("x"))) == "urn:x" and one(spark, T.datatype_iri(F.lit("number"))).endswith("#double") and one(spark, T.datatype_iri(F.lit("uri"))) is None
    assert one(spark, T.content_hash(F.lit("a"))).startswith("ca978112") and one(spark, T.policy_key(F.lit("p"), F.lit(3))) == "p@3"


def test_projection_content_follows_merges_and_equals_a_rebuild(spark, tmp_path):
    claims = spark.createDataFrame([(i, f"e:{i % 4}", "p", None if i % 2 else "v", "e:3" if i % 2 else None, "retracted" if i == 5 else "asserted") for i in range(12)], "claim_id long, subject_id string, predicate string, object_value string, object_entity_id string, status string")
    shape = "event_id long, t string, claim_id long, kind string, absorbed_id string, surviving_id string"
    batches = [[(i, "2024-01-01", i, "claim.asserted", None, None) for i in range(6)], [(10, "2024-01-02", 7, "claim.asserted", None, None), (11, "2024-01-02", 0, "context.accessed", None, None)], [(20, "2024-01-03", None, "entity.merged", "e:3", "e:1")], [(30, "2024-01-04", 8, "claim.asserted", None, None)], [(40, "2024-01-05", None, "entity.merge_reverted", "e:3", "e:1"), (41, "2024-01-05", None, "entity.merged", "e:2", "e:0")]]
    frames = [spark.createDataFrame(b, shape).withColumn("occurred_at", F.col("t").cast("timestamp_ntz")).drop("t") for b in batches]
    embed = lambda t: F.array(F.length(t).cast("double"))
    folder = f"file://{tmp_path}/c"
    merge = projection.content_batch(folder, lambda session: claims, embed)
    log = None
    shown = ("claim_id", "canonical_subject", "canonical_object", "text", "vector")
    for n, frame in enumerate(frames):
        merge(frame, n)
        merge(frame, n)
        log = frame if log is None else log.unionByName(frame)
        assert rows(projection.Versions(spark, f"{folder}/content").read(), *shown) == rows(projection.content(claims, log, embed), *shown), n
    final = {r[0]: r for r in rows(projection.content(claims, log, embed), *shown)}
    assert final[3][1] == "e:3" and final[2][1] == "e:0" and 5 not in final and set(final) == {0, 1, 2, 3, 4, 7, 8}
    newest = projection.newest(spark.createDataFrame([(1, "2024-01-01", 4, "claim.asserted", None, None), (2, "2024-01-02", 4, "entity.merged", "a", "b")], shape).withColumn("occurred_at", F.col("t").cast("timestamp_ntz")))
    assert newest.first()["kind"] == "claim.asserted"


def test_versions_keep_the_last_few(spark, tmp_path):
    table = projection.Versions(spark, f"file://{tmp_path}/v", buckets=2, keep=2)
    for n in range(5):
        table.write(spark.createDataFrame([(n % 2, n), (2, n)], "claim_id long, n int"), n)
    assert all(len(p) <= 2 for p in table._places(None).values())
    table.write(spark.createDataFrame([(1, 9)], "claim_id long, n int"), 5, whole=True)
    assert rows(table.read(), "claim_id", "n") == [(1, 9)] and table.read(0) is None


def test_sources_and_sinks(spark, tmp_path):
    for name, body in (("a/x.txt", "one"), ("a/sub/y.md", "two"), ("b/z.json", "three")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    requests = spark.createDataFrame([('{"text":"u"}', None), (None, f"{tmp_path}/a"), (None, f"{tmp_path}/b/"), (None, f"{tmp_path}/a"), (None, "")], "body string, path string")
    assert rows(files.dispatch(spark, requests), "path", "text") == [("sub/y.md", "two"), ("untitled.txt", "u"), ("x.txt", "one"), ("z.json", "three")]
    known = spark.createDataFrame([("u1", "h1"), ("u2", "h2")], "uri string, content_hash string")
    listing = spark.createDataFrame([("u1", "h1"), ("u2", "h9"), ("u3", "h3")], "uri string, content_hash string")
    assert rows(files.new_objects(listing, known), "uri") == [("u2",), ("u3",)]
    scoped = spark.createDataFrame([("t", "n", 1), ("t", "m", 2), ("u", "n", 3)], "tenant_id string, namespace_id string, id int")
    assert rows(files.scan(scoped, "t"), "id") == [(1,), (2,)] and rows(files.scan(scoped, "t", "m"), "id") == [(2,)]
    assert rows(files.lookup(spark.createDataFrame([(1,), (9,)], "id int"), scoped, "id"), "id", "tenant_id") == [(1, "t"), (9, None)]
    blobs = spark.createDataFrame([("k1", bytearray(b"hi"), "text/plain"), ("k2", bytearray(b"\x00"), "image/png")], "blob_key string, content binary, content_type string")
    held = spark.createDataFrame([("e1", "k1"), ("e2", "k2"), ("e3", "k9")], "evidence_id string, blob_key string")
    assert rows(files.evidence_content(held, blobs), "evidence_id", "text") == [("e1", "hi"), ("e2", None), ("e3", None)]
    assert sinks.put_blobs(blobs.union(blobs), blobs.where("blob_key = 'k1'")).count() == 1
    stored = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [2.0])], "claim_id int, written_at int, vector array<double>")
    assert rows(sinks.put_embeddings(stored, spark.createDataFrame([(1, 2, [9.0])], stored.schema)), "claim_id", "vector") == [(1, [9.0]), (2, [2.0])] and sinks.clear_embeddings(stored).count() == 0
    log = spark.createDataFrame([("a",), ("a",), ("b",)], "event_id string")
    assert rows(sinks.new_events(log, log.where("event_id = 'b'")), "event_id") == [("a",)]
    sinks.append(scoped, f"{tmp_path}/t", ["tenant_id"])
    sinks.append(scoped.where("id = 3"), f"{tmp_path}/t", ["tenant_id"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    landing = f"{tmp_path}/landing"
    sinks.write_requests(spark.createDataFrame([("ingest", "b", None), ("other", "c", None)], "kind string, body string, path string"), landing)
    seen = []
    stream = files.landed_requests(spark, landing)
    query = projection.process_requests(stream, {"ingest": lambda batch, n: seen.extend(r["body"] for r in batch.collect())}, f"{tmp_path}/ck").start()
    query.awaitTermination()
    assert seen == ["b"] and projection.progress(query)["rows"] == 2
    projected = spark.createDataFrame([(1, "old"), (2, "old")], "claim_id int, text string")
    assert rows(sinks.upsert(projected, spark.createDataFrame([(1,), (2,)], "claim_id int"), spark.createDataFrame([(1, "new")], projected.schema)), "claim_id", "text") == [(1, "new")]


def test_records_and_measures(spark):
    made = records.claims(spark.createDataFrame([("s", "p", "v", "2024-01-01")], "subject_id string, predicate string, object_value string, valid_from string"), stamp("2024-01-02 00:00:00")).first()
    assert made["status"] == "asserted" and made["asserted_at"] == made["recorded_at"] and len(made["claim_id"]) == 64
    merged = records.merge_events(spark.createDataFrame([("a", ["c", "b"])], "surviving_id string, absorbed_ids array<string>"), stamp("2024-01-02 00:00:00")).first()
    again = records.merge_events(spark.createDataFrame([("a", ["b", "c"])], "surviving_id string, absorbed_ids array<string>"), stamp("2024-01-02 00:00:00")).first()
    assert merged["event_id"] == again["event_id"] and merged["kind"] == "entity.merged"
    kept = records.policy_versions(spark.createDataFrame([("p", 1), ("p", 2)], "policy_id string, version int"))
    assert kept.select("version_id").distinct().count() == 2
    assert one(spark, records.provenance(F.lit("s"), F.lit("a"), F.lit("p"), F.lit("t")))["parent_ids"] == []
    numbers = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], "n int, ok boolean")
    assert evaluate.selectivity(numbers, F.col("ok")).first()["selectivity"] == 0.25 and evaluate.fallback_rate(numbers, F.col("ok")).first()["fallback_rate"] == 0.25
    other = numbers.where("n < 4").union(numbers.where("n = 1"))
    assert rows(evaluate.row_differences(numbers, other), "n", "only_in") == [(1, "right"), (4, "left")]
    named = spark.createDataFrame([("t", "n", "Acme", ["A", "AC"]), ("t", "n", " acme", ["A"]), ("t", "n", "Bo", [])], "tenant_id string, namespace_id string, label string, aliases array<string>")
    assert rows(records.entities(named), "label") == [(" acme",), ("Bo",)] and rows(records.entity_names(named), "name", "source") == [(" acme", "label"), ("A", "alias"), ("AC", "alias"), ("Acme", "label"), ("Bo", "label")]
    edges = spark.createDataFrame([("c1", "h", "a"), ("c2", "h", "b"), ("c3", "a", None)], "claim_id string, subject_id string, object_entity_id string")
    assert rows(graph.hubs(edges, 1), "entity", "claims") == [("a", 2), ("h", 2)]


def test_ingest_makes_all_tables(spark):
    docs = spark.createDataFrame([(1, "Alice is the boss. Nothing more."), (2, "Alice is away.")], "doc_id long, text string").withColumn("recorded_at", stamp("2024-01-01 00:00:00"))
    made = extract.ingest(docs, "t", "n", 4)
    assert rows(made["evidence"], "uri") == [("doc/1.txt",), ("doc/2.txt",)] and rows(made["entities"], "label") == [("Alice",), ("document",)]
    assert made["events"].count() == made["outbox"].count() == 6 and rows(made["events"].groupBy("kind").count(), "kind", "count") == [("claim.asserted", 4), ("evidence.ingested", 2)]
    states = rows(made["claims"].groupBy("predicate", "status").count(), "predicate", "status", "count")
    assert states == [("is", "asserted", 1), ("is", "conflicted", 1), ("mentions", "asserted", 1), ("mentions", "conflicted", 1)] and made["embeddings"].count() == 4
    blobs = docs.select(F.col("text").cast("binary").alias("content"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("blob_key"))
    kept = spark.createDataFrame([("e1", "k1"), ("e2", "k9")], "evidence_id string, blob_key string")
    asked = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "evidence_id string")
    assert rows(extract.reextract(asked, kept, blobs).where("predicate = 'is'"), "doc_id", "subject_label", "object_value") == [("e1", "Alice", "the boss.")]


def test_extension_points(spark):
    embed = extension.embedding(lambda texts: [[float(len(t))] for t in texts], batch=2)
    assert rows(spark.createDataFrame([("a",), (None,), ("abc",), ("ab",)], "t string").select("t", embed(F.col("t")).alias("v")), "t", "v") == [("a", [1.0]), ("ab", [2.0]), ("abc", [3.0]), (None, None)]
    drafts = extension.extraction(lambda t: [("s", "p", w, 0.5) for w in t.split()])(spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string"))
    assert rows(drafts, "doc_id", "place", "object_value") == [(1, 0, "x"), (1, 1, "y")]
    hits = spark.createDataFrame([(1, 5, "q", 1), (1, 6, "q", 2)], "query_id long, claim_id long, query string, rank int")
    order = extension.reranking(lambda q, ids: sorted(ids, reverse=True)[:1])(hits)
    assert rows(fusion.rerank(hits, order), "claim_id", "place") == [(6, 1)]
