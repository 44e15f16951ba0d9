"""Perspectives and readers in retrieval, policies as a table, the graph index with filters, and the plane sweep, against plain Python."""

from __future__ import annotations

import datetime as dt
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimstead.functions import text as T
from claimstead.functions.temporal import stamp
from claimstead.operators import access, conflicts, decisions, evaluate, identity, lexical_index, lifecycle, listing, memory, perspective, policy, search, sweep, temporal, vector_graph, write_access
from claimstead.operators.identity import settle
from claimstead.plans import retrieval, serving
from claimstead.sources import knowledge

DAY = dt.timedelta(days=1)
START = dt.datetime(2020, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# Retrieval

PLACE = "claim_id long, text string, tenant_id string, namespace_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, classification string, visibility string, owner_id string"


def _question(spark, readers, **columns):
    q = spark.createDataFrame([(i,) for i in range(len(readers))], "query_id long")
    q = q.withColumn("reader", F.get(F.array(*readers), F.col("query_id").cast("int"))).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    return perspective.asked(q.withColumns({"text": F.lit("alpha beta"), **columns}))


def test_filters_act_before_limits(spark):
    """Forty better matches of another tenant don't crowd out the reader's one, and aren't told of."""
    other = [(i, "alpha beta", "u", "n", START, None, START, "public", "workspace", None) for i in range(40)]
    mine = [(100, "alpha", "t", "n", START, None, START, "public", "workspace", None)]
    claims = spark.createDataFrame(other + mine, PLACE)
    vectors = claims.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    asked = _question(spark, [access.reader("me", "t", ["n"], "public", ["viewer"])])
    for how in (retrieval.fused, retrieval.additive):
        ranked, omitted, told = retrieval.answer(how(asked, claims, vectors, retrieval.Plan()), claims, asked, stamp("2024-01-01 00:00:00"), retrieval.Plan())
        assert rows(ranked, "claim_id", "rank") == [(100, 1)] and omitted.count() == 0 and rows(told, "resource_id", "effect") == [(100, "allow")]


def test_every_question_has_its_reader_and_instants(spark):
    held = [
        (1, "alpha", "t", "n", START, None, START, "public", "workspace", None), (2, "alpha", "t", "n", START, START + 10 * DAY, START, "tlp:red", "workspace", None),
        (3, "alpha", "t", "m", START, None, START, "public", "workspace", None), (4, "alpha", "t", "n", START, None, START + 30 * DAY, "public", "private", "you"), (5, "alpha", "u", "n", START, None, START, "public", "workspace", None),
    ]
    claims = spark.createDataFrame(held, PLACE)
    edges = claims.select("claim_id", *perspective.CLAIM, F.lit("a").alias("subject_id"), F.lit("b").alias("object_entity_id"))
    vectors = claims.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    readers = [access.reader("me", "t", ["n", "m"], "public", ["viewer"]), access.reader("you", "t", ["n"], "tlp:red", ["viewer"]), access.reader("bot", "u", ["n"], "tlp:red", ["viewer"], "agent", "you"), access.reader("me", "t", ["m", "n"], "public", ["viewer"])]
    k = F.col("query_id")
    both = F.struct(stamp("2020-01-05 00:00:00").alias("valid_at"), stamp("2020-01-06 00:00:00").alias("known_at"))
    asked = _question(spark, readers, temporal=F.when(k == 0, both), as_of=F.when(k == 1, stamp("2020-03-01 00:00:00")))
    at = {r["query_id"]: (r["tenant_id"], r["namespace_id"], r["valid_at"], r["known_at"]) for r in asked.collect()}
    assert at[0] == ("t", "n", START + 4 * DAY, START + 5 * DAY) and at[1] == ("t", "n", dt.datetime(2020, 3, 1), None) and at[3] == ("t", "m", None, None)
    plan = retrieval.Plan()
    ranked, omitted, told = retrieval.answer(retrieval.fused(asked, claims, vectors, plan, edges), claims, asked, stamp("2024-01-01 00:00:00"), plan, spark.createDataFrame([("u", 1), ("t", 3)], "tenant_id string, claim_id long"))
    assert rows(ranked, "query_id", "claim_id") == [(0, 1), (1, 1), (1, 4)]
    assert rows(omitted, "query_id", "classification", "omitted") == [(0, "tlp:red", 1), (2, "public", 1)]
    assert rows(told, "query_id", "principal_id", "resource_id", "reason") == [(0, "me", 1, "ALLOW"), (0, "me", 2, "CLASSIFICATION_DENIED"), (1, "you", 1, "ALLOW"), (1, "you", 4, "ALLOW"), (2, "bot", 5, "DELEGATION_DENIED")]
    receipt = {r["query_id"]: r for r in retrieval.receipts(ranked, omitted, asked, told, spark.createDataFrame([(1, "e1"), (1, "e0")], "claim_id long, evidence_id string")).collect()}
    assert [x["claim_id"] for x in receipt[1]["selected"]] == [1, 4] and receipt[1]["selected"][0]["evidence_ids"] == ["e0", "e1"] and receipt[1]["selected"][1]["evidence_ids"] == []
    assert receipt[2]["selected"] is None and [x["reason"] for x in receipt[2]["authorizations"]] == ["DELEGATION_DENIED"] and receipt[0]["plan_version"] == "retrieval-v2"
    with pytest.raises(Exception, match="no namespace"):
        _question(spark, [access.reader("me", "t", [], "public", ["viewer"])]).collect()


# Policies

def test_a_red_decision_breaks_a_public_policy(spark):
    d = spark.createDataFrame([(1, "loan", "n", "tlp:red", "yes", 0.9, START)], "decision_id long, purpose string, namespace_id string, classification string, selected_outcome string, confidence double, recorded_at timestamp_ntz")
    capped = [policy.policy("p", 1, max_classification="public")]
    assert rows(policy.evaluate(d, capped), "compliant", "violations") == [(False, ["classification exceeds public"])] and rows(policy.what_if(d, capped), "would_fail") == [(True,)]
    assert policy.evaluate(d, [policy.policy("p", 1, namespaces=["m"])]).count() == 0 and policy.evaluate(d, [policy.policy("p", 1, classifications=["public"])]).count() == 0
    assert rows(policy.evaluate(d, [policy.policy(None, 1, namespaces=["m"], status="draft", until="1999-01-01 00:00:00", min_confidence=0.95)]), "violations") == [(["confidence below 0.95"],)]


def test_policy_table_equals_nested_loops(spark):
    r = random.Random(1)
    some = lambda values, p: r.sample(values, r.randint(0, 2)) if r.random() < p else None
    when = lambda p: START + r.randrange(900) * DAY + dt.timedelta(hours=r.randrange(48)) if r.random() < p else None
    made = []
    for i in range(700):
        since, length = when(0.9), r.choice([0, 1, 3, 30, 400])
        until = since + length * DAY + dt.timedelta(hours=r.randrange(5)) if since and r.random() < 0.7 else when(0.3)
        made.append((f"p{i % 90}" if i % 100 else None, i, r.choice(["active", "active", "draft"]), since, until, some(["a", "b", "c"], 0.7), some(["n", "m"], 0.5), some(["public", "tlp:red"], 0.4), 0.5, None, "internal"))
    shape = "policy_id string, version int, status string, effective_from timestamp_ntz, effective_to timestamp_ntz, purposes array<string>, namespace_ids array<string>, classifications array<string>, min_confidence double, allowed_outcomes array<string>, max_classification string"
    asked = [(i, r.choice(["a", "b", "z", None]), r.choice(["n", "m", None]), r.choice(["public", "tlp:red", None]), when(0.9)) for i in range(60)]
    d = spark.createDataFrame(asked, "decision_id long, purpose string, namespace_id string, classification string, recorded_at timestamp_ntz")
    got = policy.applicable_policies(d, spark.createDataFrame(made, shape)).select("decision_id", "policy.version").collect()

    def fits(p, q):
        pid, _, status, since, until, *lists = p[:8]
        if pid is None:
            return True
        at = q[4]
        return status == "active" and (at is None or ((since is None or at >= since) and (until is None or at < until))) and all(v is None or have is None or v in have for have, v in zip(lists, q[1:4], strict=True))

    want = sorted((q[0], p[1]) for q in asked for p in made if fits(p, q))
    assert sorted(map(tuple, got)) == want and len(want) > 500


# Graph index

def test_graph_index_with_filters(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(900, 16))
    m[100:130] = m[7]
    since = [START + (i % 5) * DAY for i in range(900)]
    data = [(i, "t" if i % 4 else "u", "a" if i % 3 else ("b" if i % 2 else "rare"), since[i], START + 3 * DAY if i % 10 == 0 else None, since[i], [float(x) for x in m[i]]) for i in range(900)]
    v = spark.createDataFrame(data, "claim_id long, tenant_id string, namespace_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, vector array<double>")
    ways = [("t", None, None, None), ("t", "a", START + 4 * DAY, START + 4 * DAY), ("u", "rare", START + 2 * DAY, None), ("none", None, None, None)]
    asked = [(w * 1000 + i, *way, [float(x) for x in m[i]]) for w, way in enumerate(ways) for i in range(0, 900, 60)]
    q = spark.createDataFrame(asked, "query_id long, tenant_id string, namespace_id string, valid_at timestamp_ntz, known_at timestamp_ntz, vector array<double>")
    index = vector_graph.build(v, shard=400)
    assert rows(index.groupBy("tenant_id", "shard").count(), "tenant_id", "shard") == [("t", 0), ("t", 1), ("u", 0)]
    found = vector_graph.graph_top_k(index, q, 10)
    exact = search.vector_top_k(q, v, 10)
    each = evaluate.recall_at_k(exact, found).collect()
    assert len(each) == 45 and np.mean([r["recall"] for r in each]) >= 0.95 and min(r["recall"] for r in each) >= 0.8
    held = {x[0]: x for x in data}
    for r in found.collect():
        c, way = held[r["claim_id"]], ways[r["query_id"] // 1000]
        assert c[1] == way[0] and way[1] in (None, c[2]) and (way[2] is None or (c[3] <= way[2] and (c[4] is None or way[2] < c[4]))) and (way[3] is None or c[5] <= way[3])
    narrow = lambda df: rows(df.where("query_id >= 2000"), "query_id", "claim_id", "score", "rank")
    assert narrow(found) == narrow(exact)


def test_walk_reads_little_and_finds_all_when_widened():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(4000, 12)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = vector_graph.neighbours(unit.astype(float))
    assert all(i in set(links[j].tolist()) or len(links[j]) == 2 * vector_graph.LINKS or len(links[i]) == 2 * vector_graph.LINKS for i in range(50) for j in links[i].tolist())
    reads = []
    for i in range(0, 4000, 200):
        found, read = vector_graph.walk(unit, links, np.ones(4000, bool), unit[i], 10, 24)
        assert i in set(found.tolist())
        reads.append(read)
    assert np.mean(reads) < 1500
    islands = [np.array([i ^ 1]) for i in range(64)]  # nothing leads from pair to pair: the walk starts anew until all are seen
    found, read = vector_graph.walk(unit[:64], islands, np.ones(64, bool), unit[3], 64, 64)
    assert read == 64 and len(found) == 64


# Plane sweep

def _claims(seed, n=260):
    r = random.Random(seed)
    out = []
    for i in range(n):
        since = START + r.randrange(60) * DAY
        until = None if r.random() < 0.2 else since + r.choice([0, 1, 4, 20]) * DAY
        hot = r.random() < 0.5
        out.append((f"c{r.randrange(10**6):06}-{i}", "t", "n" if r.random() < 0.98 else None, "hot" if hot else f"s{r.randrange(30)}", r.choice(["p", "q"]) if not hot else "p", r.choice(["x", "y", "z", None]), r.choice(["asserted"] * 9 + ["retracted"]), since, until))
    return out


CLAIMS = "claim_id string, tenant_id string, namespace_id string, subject_id string, predicate string, object_value string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz"


@pytest.mark.parametrize("per_range", [10**6, 12])
def test_overlaps_equal_nested_loops(spark, per_range):
    made = _claims(7)
    far = dt.datetime(9999, 12, 31, 23, 59, 59, 999000)
    live = [c for c in made if c[6] != "retracted" and c[2] is not None]
    want = sorted(
        (*sorted((a[0], b[0])), a[3], a[4]) for a, b in itertools.combinations(live, 2) if a[1:5] == b[1:5] and a[5] != b[5] and a[7] < (b[8] or far) and b[7] < (a[8] or far)
    )
    got = temporal.overlap_pairs(spark.createDataFrame(made, CLAIMS), per_range)
    assert sorted(map(tuple, got.select("left_id", "right_id", "subject_id", "predicate").collect())) == want and len(want) > 1000


@pytest.mark.parametrize("per_range", [10**6, 12])
def test_conflict_sets_equal_nested_loops(spark, per_range):
    made = _claims(9)
    far = dt.datetime(9999, 12, 31, 23, 59, 59, 999000)
    live = [c for c in made if c[6] != "retracted" and c[2] is not None]
    groups = {}
    for c in live:
        groups.setdefault(c[3], []).append(c)
    want = set()
    for subject, own in groups.items():
        sets = set()
        for t in {c[7] for c in own}:
            least = {}
            for c in sorted(own):
                if c[7] <= t < (c[8] or far):
                    least.setdefault(c[5], c[0])
            if len(least) > 1:
                sets.add(tuple(sorted(least.values())))
        want |= {(subject, s) for s in sets if not any(len(o) > len(s) and set(s) <= set(o) for o in sets)}
    rules = spark.sql("SELECT 'r' AS rule_id, array('p', 'q') AS terms, 1 AS max")
    got = conflicts.detect(spark.createDataFrame(made, CLAIMS), rules, per_range=per_range)
    assert {(r["subject_id"], tuple(r["claim_ids"])) for r in got.collect()} == want and got.count() == len(want) > 20


def test_a_hot_group_is_swept_in_even_ranges(spark):
    """A third of all claims in one group: every range has its share, and what is carried into one is what still holds there, least ids alone."""
    hot = spark.range(6000).select(F.format_string("h%06d", "id").alias("claim_id"), F.lit("hot").alias("g"), F.lit(1).alias("most"), (F.col("id") % 3).alias("object"), (stamp("2020-01-01 00:00:00") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("valid_from"), stamp("9999-01-01 00:00:00").alias("valid_end"))
    rest = hot.unionByName(hot).withColumns({"g": F.concat(F.lit("g"), F.xxhash64("claim_id").cast("string")), "claim_id": F.concat(F.lit("r"), "claim_id")})
    dealt, lows = sweep._ranges(hot.unionByName(rest), ["g"], 1000)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2000 and lows.where("g = 'hot'").count() >= 5
    found = sweep.held_sets(hot.unionByName(rest), ["g"], "most", 1000).where("g = 'hot'").collect()
    assert {tuple(r["claim_ids"]) for r in found} >= {("h000000", "h000001", "h000002")} and len(found) <= 3


# Kept index

def _words(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcde0") for _ in range(r.randint(1, 5))) for _ in range(60)]
    joint = [" ", ", ", "-", "É", "\n"]
    return [None if r.random() < 0.05 else "".join(r.choice(vocabulary) + r.choice(joint) for _ in range(r.randrange(12))).title() for _ in range(n)]


@pytest.mark.parametrize("per_segment", [10**6, 9])
def test_index_equals_scans(spark, tmp_path, per_segment):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(_words(1, 200))], "claim_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*_words(2, 40), "!", None])], "query_id long, text string").withColumn("terms", F.array_distinct(T.lexical_tokens(F.col("text"))))
    lexical_index.write(texts.where("claim_id < 120"), f"{tmp_path}/i", "first", per_segment)
    for _ in range(2):  # an addition that is made again replaces itself
        lexical_index.write(texts.where("claim_id >= 120"), f"{tmp_path}/i", "second", per_segment)
    index = lexical_index.read(spark, f"{tmp_path}/i")
    for block in (256, 7):
        key = ("query_id", "claim_id", "score", "rank")
        assert rows(lexical_index.lexical_top_k(asked, index, 4, block), *key) == rows(search.lexical_top_k(asked, texts, 4), *key)
    assert rows(lexical_index.full_text_and(asked, index, 4), *key) == rows(search.full_text_and(asked, texts, 4), *key)
    assert rows(lexical_index.full_text_or(asked, index, 4), "query_id", "claim_id", "rank") == rows(search.full_text_or(asked, texts, 4), "query_id", "claim_id", "rank")


def test_index_in_perspective_equals_scan(spark):
    data = [(i, t, "t" if i % 3 else "u", ["n", "m", None][i % 5 % 3], START + (i % 7) * DAY, None if i % 4 else START + 9 * DAY, START + (i % 7) * DAY) for i, t in enumerate(_words(3, 150))]
    texts = spark.createDataFrame(data, "claim_id long, text string, tenant_id string, namespace_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz")
    ways = [("t", "n", None, None), ("t", None, START + 2 * DAY, START + 2 * DAY), ("u", "m", START + 12 * DAY, None), ("v", "n", None, None)]
    asked = spark.createDataFrame([(i, t or "a b", *ways[i % 4]) for i, t in enumerate(_words(4, 24))], "query_id long, text string, tenant_id string, namespace_id string, valid_at timestamp_ntz, known_at timestamp_ntz")
    got = lexical_index.lexical_top_k(asked, settle(lexical_index.segments(texts, per_segment=20)), 5)
    key = ("query_id", "claim_id", "score", "rank")
    assert rows(got, *key) == rows(search.lexical_top_k(asked, texts, 5), *key) and got.count() > 20


def test_kept_index_is_built_once_until_files_change(spark, tmp_path):
    frame = lambda: spark.read.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(1, "alpha")], "claim_id long, text string").write.parquet(f"{tmp_path}/t")
    first = lexical_index.kept(frame(), "t").inputFiles()
    assert lexical_index.kept(frame(), "t").inputFiles() == first
    spark.createDataFrame([(2, "alpha")], "claim_id long, text string").write.mode("append").parquet(f"{tmp_path}/t")
    again = lexical_index.kept(frame(), "t")
    assert again.inputFiles() != first and sorted(c for r in again.collect() for c in r["claim_ids"]) == [1, 2]


# Knowledge source and listings

def test_source_takes_only_new_and_changed_objects(spark, tmp_path):
    root, folder = tmp_path / "in", str(tmp_path / "out")
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("a")
    (root / "sub" / "b.txt").write_text("b")
    assert rows(knowledge.discover(spark, str(root)), "object_id", "mime", "size") == [("a.md", "text/markdown", 1), ("sub/b.txt", "text/plain", 1)]
    taken = lambda: rows(knowledge.taken_objects(spark, folder), "object_id", "content")
    knowledge.ingest(spark, str(root), folder, per_task=1)
    assert taken() == [("a.md", b"a"), ("sub/b.txt", b"b")]
    (root / "a.md").write_text("a2")
    (root / "c.bin").write_bytes(b"c")
    os.utime(root / "sub" / "b.txt", (1, 1))  # touched, not changed
    knowledge.ingest(spark, str(root), folder)
    assert taken() == [("a.md", b"a"), ("a.md", b"a2"), ("c.bin", b"c"), ("sub/b.txt", b"b")]
    assert rows(knowledge.latest_objects(spark, folder), "object_id", "content") == [("a.md", b"a2"), ("c.bin", b"c"), ("sub/b.txt", b"b")]
    knowledge.ingest(spark, str(root), folder)
    assert len(taken()) == 4


def test_source_restarts_in_the_middle_of_a_batch(spark, tmp_path):
    """A run breaks off within a batch; the next one takes the same objects, those that came meanwhile follow, and none is there twice."""
    root, folder = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for i in range(5):
        (root / f"{i}.txt").write_text(str(i))
    stream = spark.readStream.format("knowledge").option("path", str(root)).option("state", f"{folder}/listings").load()

    def broken(batch, batch_id):
        batch.limit(2).write.mode("overwrite").parquet(f"{folder}/objects/batch={batch_id}/half")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream.writeStream.foreachBatch(broken).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    (root / "9.txt").write_text("9")
    knowledge.ingest(spark, str(root), folder)
    knowledge.ingest(spark, str(root), folder)
    assert rows(knowledge.taken_objects(spark, folder), "object_id") == [(f"{i}.txt",) for i in (0, 1, 2, 3, 4, 9)]


def test_pages_join_to_the_whole_order(spark):
    r = random.Random(3)
    data = [(r.choice([None, 1, 2, 3]), i) for i in range(57)]
    df = spark.createDataFrame(data, "at int, id long").repartition(5)
    want = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    found, cursor, n = [], None, 0
    while n == 0 or cursor is not None:
        part, cursor = listing.page(df, ["at", "id"], 10, cursor)
        found += [tuple(x) for x in part.orderBy(F.col("at").asc_nulls_first(), "id").collect()]
        n += 1
    assert found == want and n == 6
    whole = listing.pages(df, ["at", "id"], 10, per_range=9).orderBy("place").collect()
    assert [(x["at"], x["id"]) for x in whole] == want and [(x["place"], x["page"]) for x in whole] == [(i, i // 10) for i in range(57)]
    assert listing.pages(df.where("false"), ["at", "id"], 10).count() == 0


# Write checks

def test_entities_are_merged_by_writers_alone(spark):
    held = spark.createDataFrame([("a", "t", "n", "public"), ("b", "t", "n", "tlp:red"), ("c", "t", "m", "public")], "resource_id string, tenant_id string, namespace_id string, classification string").withColumns({"visibility": F.lit("workspace"), "owner_id": F.lit("x")})
    who = [access.reader("w0", "t", ["n"], "tlp:red", ["editor"]), access.reader("w1", "t", ["n"], "public", ["editor"]), access.reader("w2", "t", ["n", "m"], "tlp:red", ["viewer"])]
    asked = spark.createDataFrame([(1, 0, ["a", "b"]), (2, 1, ["a", "b"]), (3, 0, ["a", "c"]), (4, 2, ["a", "a"]), (5, 0, ["a", "zz"])], "request_id int, w int, members array<string>").withColumn("writer", F.get(F.array(*who), F.col("w")))
    told, receipts = write_access.entity_write(asked, asked.select("request_id", F.explode("members").alias("resource_id")), held, "entity.merge", stamp("2024-01-01 00:00:00"))
    assert rows(told, "request_id", "errors") == [(1, []), (2, ["CLASSIFICATION_DENIED"]), (3, ["NAMESPACE_DENIED"]), (4, ["ACTION_DENIED"]), (5, ["NOT_FOUND"])]
    assert rows(receipts, "request_id", "resource_id", "effect")[:4] == [(1, "a", "allow"), (1, "b", "allow"), (2, "a", "allow"), (2, "b", "deny")]
    fine = asked.select("request_id", F.array().cast("array<string>").alias("errors"))
    made = lifecycle.applied(asked, fine, ["request_id"], "entity.merged", stamp("2024-01-01 00:00:00"), told)
    assert rows(made["accepted"], "request_id") == [(1,)] and rows(made["rejected"], "request_id")[0] == (2,) and made["events"].count() == 1


def test_facts_and_decisions_need_a_writer_and_readable_evidence(spark):
    d = spark.createDataFrame([(1, "t", "n", "public"), (2, "t", "n", "tlp:red")], "decision_id long, tenant_id string, namespace_id string, classification string").withColumn("visibility", F.lit("workspace"))
    proof = spark.createDataFrame([("e", "t", "n", "public"), ("s", "t", "n", "tlp:red")], "evidence_id string, tenant_id string, namespace_id string, classification string")
    w = access.reader("w", "t", ["n"], "internal", ["editor"])
    asked = spark.createDataFrame([(1, 1, ["e"]), (2, 1, ["e", "s"]), (3, 1, ["zz"]), (4, 2, []), (5, 9, ["e"])], "request_id int, decision_id long, evidence_ids array<string>").withColumns({"writer": w, "outcome": F.lit("ok")})
    made = write_access.record_facts(asked, "outcome", d, stamp("2024-01-01 00:00:00"), proof)
    assert rows(made["records"], "request_id", "recorded_by") == [(1, "w")] and rows(made["events"], "kind") == [("decision.outcome_observed",)]
    assert rows(made["rejected"], "request_id", "errors") == [(2, ["CLASSIFICATION_DENIED"]), (3, ["EVIDENCE_NOT_FOUND"]), (4, ["CLASSIFICATION_DENIED"]), (5, ["NOT_FOUND"])]
    assert made["receipts"].count() == 10 and made["records"].select("outcome_id").first()[0]
    for fact in ("relation", "exception", "approval"):
        assert write_access.record_facts(asked.drop("evidence_ids"), fact, d, stamp("2024-01-01 00:00:00"))["records"].count() == 3
    requests = spark.createDataFrame([(1, 1, "me", "loan", "yes", 0.9, "{}", "public"), (2, 1, "me", "loan", "yes", 0.9, "{}", "tlp:red")], "request_id long, query_id long, actor string, purpose string, selected_outcome string, confidence double, payload string, classification string")
    requests = requests.withColumns({"tenant_id": F.lit("t"), "namespace_id": F.lit("n"), "visibility": F.lit("workspace"), "writer": w})
    kept = spark.createDataFrame([(1, "s", [], [])], "query_id long, snapshot_id string, evidence_ids array<string>, policy_refs array<struct<policy_id:string,version:int>>")
    done = decisions.record(requests, kept, [policy.policy("p", 1, 0.95)], stamp("2024-01-01 00:00:00"))
    assert rows(done["decisions"], "request_id", "tenant_id") == [(1, "t")] and rows(done["rejected"], "request_id", "errors") == [(2, ["CLASSIFICATION_DENIED"])] and done["evaluations"].count() == 1


def test_unreadable_entities_are_no_candidates(spark):
    names = spark.createDataFrame([(1, "acme corp", "label", 1), (2, "acme corp", "label", 2), (3, "acme", "label", 3)], "entity_id long, name string, source string, canonical_id long")
    scope = spark.createDataFrame([(1, "n"), (2, "m"), (3, "n")], "entity_id long, namespace_id string").withColumns({"tenant_id": F.lit("t"), "classification": F.lit("public"), "visibility": F.lit("workspace"), "owner_id": F.lit(None).cast("string")})
    asked = spark.createDataFrame([(7, "acme corp"), (8, "acme corp")], "query_id long, name string").withColumn("reader", F.when(F.col("query_id") == 7, access.reader("a", "t", ["n"], "public", ["viewer"])).otherwise(access.reader("b", "t", ["n", "m"], "public", ["viewer"])))
    found = identity.candidates(asked.drop("reader"), names, readable=identity.readable_entities(asked, scope, stamp("2024-01-01 00:00:00")))
    assert rows(found, "query_id", "entity_id") == [(7, 1), (7, 3), (8, 1), (8, 2), (8, 3)]


def test_memories_are_recorded_and_found(spark):
    w = access.reader("me", "t", ["n"], "internal", ["editor"])
    asked = spark.createDataFrame([(1, "me", "note", "Blue Sky", "n"), (2, "me", "note", None, "n"), (3, "you", "note", "blue", "m")], "request_id int, owner_id string, kind string, body string, namespace_id string").withColumns({"tenant_id": F.lit("t"), "classification": F.lit("public"), "visibility": F.lit("private"), "writer": w})
    kept, refused = memory.record(asked, stamp("2024-01-01 00:00:00"))
    assert rows(refused, "request_id", "reason") == [(3, "VISIBILITY_DENIED")] and kept.count() == 2
    q = spark.createDataFrame([(1, "BLUE s"), (2, None), (3, "red")], "query_id int, text string").withColumn("reader", w)
    assert rows(memory.search(kept, q, stamp("2024-01-01 00:00:00")), "query_id", "request_id") == [(1, 1), (2, 1), (2, 2)]


# Serving

def test_questions_fall_back_where_indexes_are_missing_or_stale(spark):
    data = [(i, t or "x", "t" if i % 2 else "u", "n", START, None, START) for i, t in enumerate(_words(5, 80))]
    texts = spark.createDataFrame(data, "claim_id long, text string, tenant_id string, namespace_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz")
    vectors = texts.withColumn("vector", T.hash_embedding(F.col("text"), 4))
    asked = spark.createDataFrame([(i, t or "a b", "t" if i % 2 else "u", "n", None, None) for i, t in enumerate(_words(6, 8))], "query_id long, text string, tenant_id string, namespace_id string, valid_at timestamp_ntz, known_at timestamp_ntz").withColumn("vector", T.hash_embedding(F.col("text"), 4))
    indexes = serving.Indexes(settle(lexical_index.segments(texts)), settle(vector_graph.build(vectors)), spark.createDataFrame([("t", START), ("u", START)], "tenant_id string, indexed_at timestamp_ntz"))
    log = spark.createDataFrame([("t", "claim.asserted", START), ("u", "claim.asserted", START), ("u", "context.accessed", START + DAY)], "tenant_id string, kind string, occurred_at timestamp_ntz")
    now = stamp("2020-01-02 00:00:00")
    rate = lambda df: tuple(serving.rates(df).first())
    healthy = serving.routed(asked, serving.freshness(indexes.catalogue, log, now))
    assert rate(healthy) == (8, 0, 0.0) and rate(serving.routed(asked, None)) == (8, 8, 1.0) and rate(healthy.where("false")) == (0, 0, 0.0)
    late = log.union(spark.createDataFrame([("u", "claim.retracted", START + 10 * dt.timedelta(minutes=1))], log.schema))
    half = serving.routed(asked, serving.freshness(indexes.catalogue, late, now))
    assert rows(half, "tenant_id", "route", "fallback")[0] == ("t", "projection", None) and rate(half) == (8, 4, 0.5) and {r["fallback"] for r in half.collect()} == {None, "stale"}
    assert rate(serving.routed(asked, serving.freshness(indexes.catalogue, late, stamp("2020-01-01 00:10:20")))) == (8, 0, 0.0)  # within the lag that is allowed
    assert {r["fallback"] for r in serving.routed(asked.withColumn("known_at", stamp("2020-01-01 00:00:00")), serving.freshness(indexes.catalogue, log, now)).collect()} == {"known-at"}
    plan = retrieval.Plan(lexical=5, vector=6)
    for strategy in ("lexical", "vector"):
        ways = [serving.candidates(strategy, routes, indexes, texts, vectors, plan) for routes in (healthy, half, serving.routed(asked, None))]
        answers = [rows(w, "query_id", "claim_id", "score", "rank") for w in ways]
        assert answers[0] == answers[1] == answers[2] and len(answers[0]) > 10
        assert {r["route"] for r in ways[1].collect()} == {"projection", "canonical"}
