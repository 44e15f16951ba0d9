"""The pipeline's stages: their decisions against plain Python, odd rows, clashing columns."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] > 0
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_one_row_of_equal_and_near_copies_stays(spark, sf_dir):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(3, base, "en", "a", 1), (3, base, "en", "a", 1), (9, base + " more", "en", "b", 1), (5, "unlike text altogether here", None, None, 1), (None, "x y z q r", None, None, None), (None, "x y z q r", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 3), (False, 5), (True, 0)]


def test_near_copies_from_a_similarity_of_080_go_and_others_stay(spark, sf_dir):
    rng = random.Random(5)

    def grams(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    rows, gone = [], set()
    for k in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = list(base)
        for i in rng.sample(range(300), 1 + k % 16):
            copy[i] = f"new{k}x{i}"
        a, b = grams(base), grams(copy)
        rows += [(2 * k, " ".join(base), "en", "a", 1), (2 * k + 1, " ".join(copy), "en", "a", 1)]
        if len(a & b) >= 0.8 * len(a | b):
            gone.add(2 * k + 1)
    assert 15 < len(gone) < 45
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert kept == set(range(120)) - gone


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size string, taken int, copies int, n_removed string, target string, _tie int, root int"


def clashing(spark, rows):
    """Rows (doc_id, text, source) with columns named as those that operators and stages add."""
    return spark.createDataFrame([(i, t, "en", s, -1, "own", 7, 8, "own", "own", 9, 10) for i, t, s in rows], CLASHING)


ODD = [(1, None, None), (2, "", "a"), (3, " \n ", "b"), (4, "one two three", "a"), (4, "one two three", "a"), (4, "another text", "b"), (None, "no id", None), (None, "no id", None), (5, " ".join(f"w{i * 7919 % 10007}" for i in range(30_000)), "a"), (6, "one two three", "b")]


def own_columns(rows):
    return all((r["size"], r["taken"], r["copies"], r["n_removed"], r["target"], r["_tie"], r["root"]) == ("own", 7, 8, "own", "own", 9, 10) for r in rows)


def test_stages_keep_clashing_columns_and_odd_rows(spark, sf_dir):
    docs = clashing(spark, ODD)
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and own_columns(out.collect()), stage
    whole = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).collect()), key=repr)
    assert whole == sorted(((i, t) for i, t, _ in ODD), key=repr)
    # one of the texts without words, one of those with one text, one of the two rows without an id
    near = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()), key=repr)
    assert near == sorted([(1, None), (4, "one two three"), (4, "another text"), (None, "no id"), (5, ODD[8][1])], key=repr)
    bare = docs.select("doc_id", "text")
    assert corpus_pipeline.drop_repeated_lines(spark, bare, sf_dir).columns == bare.columns
    assert corpus_pipeline.pack(spark, docs, sf_dir).where("start = 0").count() == len(ODD)


def test_quality_stage_keeps_what_the_model_scores(spark, sf_dir):
    from claimstead.llm import quality_classifier as q
    from claimstead.llm.common import fold, labels

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = "/root/testdata/sf0.01"
    model = q.learn(q.document_statistics(docs), labels(spark, folder).where(fold("doc_id", 5) != 0).select("doc_id", "quality"))
    want = {r["doc_id"] for r in docs.collect() if model.score(q.np.array([q.statistics(r["text"] or "")]))[0] >= 0.3}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, folder).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels(spark, folder).where("quality IS NOT NULL").collect()}
    assert kept == want and 0 < len(kept) < docs.count()
    assert sum(i in kept for i, y in truth.items() if y == 1) >= 0.98 * sum(truth.values()) and sum(i in kept for i, y in truth.items() if y == 0) <= 0.1 * sum(1 - y for y in truth.values())


def test_line_stage_drops_what_is_mostly_repeated(spark, sf_dir):
    words = [f"w{i}" for i in range(400)]
    text = lambda w: " ".join(x + ("." if i % 9 == 8 else "") for i, x in enumerate(w))
    own = [f"own{i}" for i in range(100)]
    rows = [(1, text(words), "a"), (2, text(words[:360]) + "\n" + " ".join(own[:30]), "a"), (3, text(words[:90]) + "\n" + " ".join(own[30:90]), "a"), (4, text(words), "b")]
    out = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, clashing(spark, rows), sf_dir).collect()}
    assert set(out) == {1, 3} and out[1]["text"] == rows[0][1] and out[1]["n_chars"] == -1
    assert out[3]["text"] == " ".join(own[30:90]) and out[3]["n_chars"] == len(out[3]["text"])


def test_mixing_stage_repeats_documents_as_taken(spark, sf_dir):
    from claimstead.llm.mixing import pareto_mix

    rng = random.Random(8)
    docs = clashing(spark, [(i, "w " * rng.randrange(0, 30), rng.choice("aab")) for i in range(300)])
    want = {r["doc_id"]: r["copies"] for r in pareto_mix(docs.select("doc_id", "text", "source")).collect()}
    seen = {}
    for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: n for i, n in want.items() if n} and len(set(want.values())) > 2


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_run_equals_the_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    # which window holds a piece hangs on how rows are dealt; pieces themselves don't
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (corpus_pipeline.run(spark, sf_dir), docs))
    assert got == want and len(got) > 100
