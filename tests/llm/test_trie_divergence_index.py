"""Prefix trie, source divergence and multi-index against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimstead.llm import multi_index, prefix_trie, source_divergence

TURN = "conv_id long, turn long, role string, text string, pos string, id string, total string, trie string"


def plain_trie(convs: dict[int, list]) -> list[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        leaves, saved, left = 0, 0, [p]
        while left:
            x = left.pop()
            leaves += x not in kids
            saved += (len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
            left += kids.get(x, [])
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed: int = 3) -> list[tuple]:
    r, rows = random.Random(seed), []
    base = [("user", ""), ("user", "aé"), ("us", "eraé"), (None, "x" * 40), ("user", None)]
    for c in range(70):
        turns = [r.choice(base) for _ in range(r.choice([1, 2, 3, 5, 7, 12]))]
        if c % 3 == 0:
            turns = [base[1]] * 6 + [base[c % 2]] * (c % 4)
        rows += [(c, i if i else None, role, text, "a", "b", "c", "d") for i, (role, text) in enumerate(turns)]
    rows += [(200, i, "user", f"long {i}", "a", "b", "c", "d") for i in range(300)] + [(201, i, "user", f"long {i}", "a", "b", "c", "d") for i in range(290)]
    return [*rows, (None, 1, "user", "x", "a", "b", "c", "d"), (-3, 0, "user", "aé", "a", "b", "c", "d")]


def sessions(rows: list[tuple]) -> dict[int, list]:
    convs: dict[int, list] = {}
    for c, _, role, text, *_ in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


@pytest.mark.parametrize(("width", "per_range"), [(64, 10**6), (64, 40), (2, 60)])
def test_trie_equals_plain_python_in_any_cut(spark, width, per_range):
    rows = talk()
    if width == 2:  # a trie for each two turns of what two conversations share: keep that short
        rows = [r for r in rows if r[0] not in (200, 201) or r[1] < 9]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURN).repartition(5), width, per_range).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(sessions(rows))


def test_op11_rebuilds_as_told(spark, tmp_path):
    rows = [(c, i, role, text) for c, i, role, text, *_ in talk(5)]
    rows += [(1001, 0, "user", "orphan"), (1004, 0, "user", "orphan")]  # their base is absent
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    convs = sessions(rows)
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    assert any(not t for t in made.values())
    got = prefix_trie.op11_prefix_trie(spark, str(tmp_path), per_range=50).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(made)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURN)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", *"abcd")], TURN)).count() == 0


def test_radix_tree_layouts_grow_and_keys_may_be_prefixes():
    r = random.Random(1)
    keys = [bytes(r.randrange(k) for _ in range(r.randrange(6))) for k in (3, 12, 40, 256) for _ in range(400)]
    tree = prefix_trie.Tree()
    for k in keys:
        tree.add(k, k)
    found, layouts, left = [], set(), [(tree.root, b"")]
    while left:
        node, before = left.pop()
        found += [(before + node.prefix, e) for e in node.ends]
        layouts.add(node.layout)
        left += [(kid, before + node.prefix + bytes([e])) for e in range(256) if node.kids and (kid := node.get(e)) is not None]
    assert sorted(found) == sorted((k, k) for k in keys)
    assert layouts == {4, 16, 48, 256}


def plain_divergence(rows: list[tuple], least: int) -> set[tuple]:
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        docs = Counter(t for *_, own in mine for t in set(own))
        kept = [t for t, n in docs.items() if n >= least]
        counts = {s: Counter(t for _, source, own in mine if source == s for t in own) for s in {x[1] for x in mine}}
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))
        whole = Counter(t for *_, own in mine for t in own)
        for s, c in counts.items():
            pairs = sorted((-sum(abs(p(c, t) - p(d, t)) for t in kept), o.encode(), o) for o, d in counts.items() if o != s)
            more = sorted((p(whole, t) - p(c, t), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t))[: source_divergence.TERMS]
            for part, listed in (("pair", pairs), ("term", more)):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(listed, 1)}
    return out


def test_divergence_equals_plain_python(spark):
    r = random.Random(2)
    words = [f"{a}{b}" for a in ("A", "é", "ZÉ", "q", "Ω") for b in ("b", "Ö", "x́", "k")] + ["Common"] * 30
    rows = [("en" if i % 3 else "fr", f"s{r.randrange(7)}", " ".join(r.choices(words, k=40)) + " 1a_b") for i in range(300)]
    rows += [("de", "s1", "nothing kept"), ("de", "s2", None), ("de", None, ""), (None, "s3", "x " * 9)] * 2 + [("en", "s99", ""), ("en", "s0", "Common " * 50_000)]
    rows = [(*x, "a", "b", "c") for x in rows]
    df = spark.createDataFrame(rows, "lang string, source string, text string, term string, n string, place string").repartition(4)
    got = [tuple(x) for x in source_divergence.divergence(df, 5).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_divergence([x[:3] for x in rows], 5)
    handed_on = source_divergence.term_counts(df, entries=40)
    assert handed_on.exceptAll(source_divergence.term_counts(df)).count() == 0


def test_divergence_in_many_blocks_and_sides(spark):
    r = random.Random(4)
    rows = [("en", f"s{i % 8}", " ".join(f"w{chr(97 + int(26 * r.random() ** 2))}{chr(97 + r.randrange(4))}" for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    cells, groups = source_divergence.levels(source_divergence.term_counts(docs), 5)
    got = {tuple(x) for x in source_divergence.pair_values(cells, groups, block=7, side=3).collect()}
    assert got == {(a, b, d, v) for a, b, part, d, v, _ in plain_divergence(rows, 5) if part == "pair"}


def test_divergence_of_nothing(spark):
    assert source_divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_traversal_takes_pairs_in_order():
    r = np.random.default_rng(0)
    for _ in range(30):
        one, two, counts = r.normal(size=6), r.normal(size=9), r.integers(0, 4, (6, 9))
        most = int(r.integers(1, 60))
        sums = one[:, None] + two[None, :]
        order = np.argsort(-sums, axis=None)
        taken = order[: int(np.searchsorted(np.cumsum(counts.ravel()[order]), most)) + 1]
        want = np.bincount(taken // 9, minlength=6)
        assert (multi_index.traverse(one, two, counts, most) == want).all()


def _vectors(n: int, width: int = 12, seed: int = 0) -> tuple[list[tuple], np.ndarray]:
    m = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    m[5:25] = m[3]  # copies: ties go to the smaller id
    return [(i, [float(x) for x in v], "q", 1) for i, v in enumerate(m)], m.astype(float)


SHAPE = "vec_id long, embedding array<float>, query_id string, i int"


def test_index_finds_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "VECTORS", 100)
    monkeypatch.setattr(multi_index, "QUERIES", 16)
    rows, m = _vectors(900)
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    got = multi_index.nearest(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    s = m @ m.T
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own["vec_id"])
        assert np.allclose(own["score"], s[q, own["vec_id"]], rtol=1e-12, atol=1e-12)
        assert own[["score", "vec_id"]].apply(lambda x: (-x["score"], x["vec_id"]), axis=1).is_monotonic_increasing
        order = np.lexsort((np.arange(900), -np.where(np.arange(900) == q, -np.inf, s[q])))[:20]
        hits += len(set(order) & set(own["vec_id"]))
    assert got["query_id"].nunique() == 45 and hits >= 0.9 * 900


def test_index_read_whole_is_exact(spark):
    rows, m = _vectors(300, seed=1)
    df = spark.createDataFrame(rows, SHAPE)
    index = multi_index.build(df)
    assert index.counts.sum() == 300
    asked = index.vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = multi_index.ranked(multi_index.search(index, asked, 20, 300), 20).toPandas().sort_values(["query_id", "rank"])
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    want = [(q, v) for q in range(0, 300, 20) for v in np.lexsort((np.arange(300), -s[q].round(12)))[:20]]
    assert list(zip(got["query_id"], got["vec_id"], strict=True)) == want


def test_index_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SHAPE)
    got = multi_index.nearest(df, F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert multi_index.nearest(df.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert multi_index.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0, 20).count() == 0
