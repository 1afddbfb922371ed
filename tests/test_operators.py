"""Operators on hand-made inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from arborist.functions import text as T
from arborist.functions import vector as V
from arborist.operators import chunk, dense, evaluate, hierarchy, lexical, navigate, replay, training, tree

TOY = [("d1", "Neural retrieval. Neural retrieval models rank scientific papers."), ("d2", "Dense search. Dense embeddings improve semantic search."), ("d3", "Pasta. Tomatoes and basil are used in pasta sauce."), ("d4", "Bread. Bread recipes often use yeast and flour.")]


def test_tokens_and_keywords(spark):
    df = spark.createDataFrame([("It's  the BIG-data, x!", "n1"), (None, "n2"), ("?!", "n3")], "t string, n string")
    rows = df.select(T.tokens(F.col("t")).alias("a"), T.keywords(F.col("t")).alias("k"), T.label(T.keywords(F.col("t")), F.col("n")).alias("l")).collect()
    assert rows[0].a == ["its", "the", "bigdata", "x"] and rows[0].k == ["big-data"] and rows[0].l == "big-data"
    assert rows[1].a == [] and rows[1].l == "Cluster n2" and rows[2].a == []


def test_hash_embedding_equals_python(spark):
    import hashlib

    for size in (64, 100, 384):
        got = spark.range(1).select(T.hash_embedding(F.lit("neural dense neural"), size).alias("v")).first().v
        want = [0.0] * size
        for t in ("neural", "dense", "neural"):
            want[int(hashlib.md5(t.encode()).hexdigest(), 16) % size] += 1
        n = math.sqrt(sum(x * x for x in want))
        assert got == pytest.approx([x / n for x in want])


def test_zero_vector_stays_zero(spark):
    assert spark.range(1).select(V.normalised(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first().v == [0.0, 0.0]


def test_bm25_finds_the_toy_document(spark):
    docs, asked = spark.createDataFrame(TOY, "doc_id string, text string"), spark.createDataFrame([("q", "neural retrieval"), ("none", "zzz"), ("null", None)], "query_id string, text string")
    top = lexical.Bm25().top(docs, asked, 2).collect()
    assert [r.doc_id for r in top if r.query_id == "q"] == ["d1"] and {r.query_id for r in top} == {"q"}
    everywhere = spark.createDataFrame([("q", "d3"), ("q", "d4")], "query_id string, doc_id string")
    assert [(r.doc_id, r.score) for r in lexical.Bm25().top(docs, asked, 2, everywhere).orderBy("rank").collect()] == [("d3", 0.0), ("d4", 0.0)]


def test_metrics_of_the_published_example(spark):
    judged = spark.createDataFrame([("q1", "doc1", 2), ("q1", "doc2", 1), ("q1", "doc5", 1), ("q2", "doc3", 1), ("q2", "doc4", 2)], "query_id string, doc_id string, rel int")
    run = spark.createDataFrame([("q1", "doc1", 0.9), ("q1", "doc2", 0.8), ("q1", "doc3", 0.7), ("q1", "doc5", 0.6), ("q2", "doc4", 0.95), ("q2", "doc3", 0.85), ("q2", "doc1", 0.5)], "query_id string, doc_id string, score double")
    m = {r.k: r for r in evaluate.means(evaluate.per_query(run, judged)).collect()}
    assert m[1].rr == 1 and m[1].precision == 1 and m[1].ndcg == 1
    assert m[1].recall == pytest.approx(0.416667, abs=1e-6) and m[3].recall == pytest.approx(0.833333, abs=1e-6) and m[10].recall == 1


def test_tree_relations(spark):
    leaves = spark.createDataFrame([(f"d{i}", f"c{i // 8}.{i // 2 % 4}") for i in range(16)], "doc_id string, node_id string")
    nodes = tree.nodes_of(leaves)
    assert nodes.count() == 11 and tree.leaves(nodes).count() == 8
    one = spark.createDataFrame([("c0.1", "c1.2", "c0.3")], "a string, b string, c string").select(
        tree.path_nodes(F.col("a")).alias("up"), tree.descent(F.lit("root"), F.col("b")).alias("down"), tree.lowest_common_ancestor(F.col("a"), F.col("b")).alias("x"), tree.lowest_common_ancestor(F.col("a"), F.col("c")).alias("y"), tree.descent(F.col("a"), F.col("b")).alias("none")
    ).first()
    assert one.up == ["root", "c0", "c0.1"] and one.down == ["root", "c1", "c1.2"] and (one.x, one.y, one.none) == ("root", "c0", None)
    assert {r.node_id: r.n_docs for r in tree.subtree_counts(leaves).collect()}["c1"] == 8
    assert tree.closure(nodes).count() == 1 + 2 * 2 + 8 * 3


def test_chunkers(spark):
    docs = spark.createDataFrame([(1, "a" * 25), (2, None), (3, ""), (4, "One. Two! Three? Four. Five. Six.")], "doc_id long, text string")
    fixed = chunk.fixed_chunks(docs, 10, 2).where("doc_id = 1").orderBy("pos").collect()
    assert [(len(r.chunk), r.start_idx, r.end_idx) for r in fixed] == [(10, 0, 10), (10, 8, 18), (9, 16, 26), (1, 24, 34)]
    assert [r.chunk for r in chunk.sentence_chunks(docs.where("doc_id = 4"), 3, 1).orderBy("pos").collect()] == ["One. Two! Three?", "Three? Four. Five.", "Five. Six."]
    text = "aa bb cc dd\nee ff gg"
    # worked by hand: the last piece is carried over even without an overlap, all pieces if they don't reach it
    assert chunk.split_recursively(text, 11, 0) == [("aa bb cc dd", 0, 11), ("aa bb cc dd\nee ff gg", -1, 19)]
    assert chunk.split_recursively("x" * 30, 10, 0) == [("x" * 10, 0, 10), ("x" * 10, 10, 20), ("x" * 10, 20, 30), ("xxx", -1, 2)]
    # after a carried piece the running length counts no separator, so the second chunk holds three
    assert chunk.split_recursively("a b c d e f g h", 5, 2) == [("a b", 0, 3), ("b c d", -1, 4), ("d e f", 6, 11), ("f g h", -1, 4)]
    assert chunk.split_recursively("", 5, 2) == [] and chunk.split_recursively("   ", 5, 2) == [("   ", 0, 3)]
    assert chunk.split_recursively("ab  cdef", 4, 1, ("\n",)) == [("ab  ", 0, 4), (" cde", 3, 7), ("ef", 6, 10)]
    import numpy as np

    assert chunk.group_sentences(["a", "b", "c"], np.array([[1, 0], [1, 0], [0, 1.0]]), 100, 0.7) == [["a", "b"], ["c"]]
    assert chunk.group_sentences(["a", "b"], np.array([[0, 0], [1.0, 0]]), 100, 0.7) == [["a", "b"]]
    for bad in ("fixed", "sentence", "recursive"):
        with pytest.raises(ValueError):
            chunk.create_chunker(bad, size=5, overlap=5)(docs)
    with pytest.raises(ValueError):
        chunk.create_chunker("other")
    semantic = chunk.create_chunker("semantic", encode=lambda s: np.eye(len(s)))(docs)
    assert semantic.where("doc_id = 4").count() == 6
    twice = spark.createDataFrame([(1, "A one b. One two. A one.")], "doc_id long, text string")
    assert [(r.chunk, r.start_idx) for r in chunk.create_chunker("semantic", encode=lambda s: np.eye(len(s)))(twice).orderBy("pos").collect()] == [("A one b.", 0), ("One two.", 9), ("A one.", 18)]


def test_lost_rows_stay(spark, tmp_path):
    """Actions beyond any number keep their rows; queries of one or two tokens are judged like others."""
    from arborist.operators import training
    from arborist.sources import corpus

    rows = spark.range(12_000).selectExpr("id as key", "cast(id as string) as action")
    assert training.sampler_weights(rows, "key", "action").count() == 12_000
    assert {r.action: r.n for r in training.class_weights(rows.where("key < 2"), "action", 3, ["0", "1", "2"]).collect()} == {"0": 1, "1": 1, "2": 0}
    split = training.group_split(rows, "key", 0.1)
    import hashlib

    first = sorted(range(12_000), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:1200]
    assert {r.key for r in split.where("validation").collect()} == set(first)
    assert training.group_split(rows, "key", 1.0).where("validation").count() == 12_000 and training.group_split(rows.where("key < 0"), "key", 0.1).count() == 0
    asked = [(1, "alpha"), (2, "alpha beta"), (3, "alpha beta gamma"), (4, "pha be"), (5, "!"), (6, "zeta alpha beta gamma")]
    texts = [(10, "an alpha beta gamma delta!"), (11, "alpha, beta"), (12, None), (13, "")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.query_id, r.doc_id, r.rel) for r in corpus.judgements(spark, str(tmp_path)).collect()}
    assert got == {(q, d, 2 if d == 10 else 1) for q, a in asked for d, t in texts if t and a in t}


def test_navigator(spark):
    from arborist.operators import navigator as N

    docs = spark.createDataFrame([(1, "apple pie", "Pie", {"doc_id": "own"}), (2, "apple tart", "", {"x": "y"}), (3, "bread", None, None)], "doc_id long, text string, title string, metadata map<string,string>")
    members = spark.createDataFrame([(1, "a.b"), (2, "a.c"), (3, "d")], "doc_id long, node_id string")
    asked = spark.createDataFrame([(7, "bread"), (8, "nothing known")], "query_id long, text string")
    rows = {r.doc_id: r for r in N.rag_documents(docs, members).collect()}
    assert rows[1].metadata == {"doc_id": "own"} and rows[2].metadata == {"x": "y", "doc_id": "2"} and rows[3].title == "" and rows[3].score == 1.0
    found = N.search(asked, docs, members, None, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.title) for r in found] == [(7, 3, "Untitled"), (8, 1, "Pie"), (8, 2, "Untitled")]
    assert [r.doc_id for r in N.search(asked.where("query_id = 7"), docs, members, "a", 5).orderBy("rank").collect()] == [1, 2]
    nodes = tree.nodes_of(members)
    cards = spark.createDataFrame([("a", "A", "s", ["k"])], "node_id string, label string, summary string, keywords array<string>")
    assert N.cluster_info("a", cards, nodes).first().depth == 1
    with pytest.raises(ValueError):
        N.cluster_info("z", cards, nodes)
    assert [r.doc_id for r in N.page(docs, "doc_id", 1).collect()] == [2, 3]


def test_built_tree_keeps_its_rules(spark):
    import random

    rng = random.Random(0)
    rows = [(i, [rng.gauss(3 * (i % 3 == k), 0.3) for k in range(3)]) for i in range(300)]
    config = hierarchy.BuildConfig(branching=3, max_depth=2, min_leaf=5, max_leaf=120, iterations=5)
    out = {r.doc_id: r.node_id for r in hierarchy.build(spark.createDataFrame(rows, "doc_id long, embedding array<double>"), config).collect()}
    assert len(out) == 300 and len(set(out.values())) > 1
    sizes = {n: sum(v == n for v in out.values()) for n in set(out.values())}
    assert all(s >= 5 for s in sizes.values()) and all(n.count(".") < 2 for n in sizes)
    small = hierarchy.build(spark.createDataFrame(rows[:10], "doc_id long, embedding array<double>"), config)
    assert {r.node_id for r in small.collect()} == {"root"}


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, doc_id string, rank int")
    one, two = ({r.doc_id: r.score for r in dense.reciprocal_ranks(*x).collect()} for x in ((a, b), (b, a)))
    assert one == two and one["y"] == pytest.approx(1 / 62 + 1 / 61)
    same = spark.createDataFrame([("q", "x", 2.0), ("q", "y", 2.0)], "query_id string, doc_id string, score double")
    assert {r.z for r in same.withColumn("z", dense.zscore("score", "query_id")).collect()} == {0.0}


def test_listwise_loss(spark):
    row = lambda m, p: spark.createDataFrame([([2.0, 1.0, 0.5, -1.0], m, p)], "s array<double>, m array<int>, p array<int>")
    lse = lambda v: math.log(sum(map(math.exp, v)))
    loss = lambda m, p: row(m, p).select(training.listwise_loss(F.col("s"), F.col("m"), F.col("p")).alias("l")).first().l
    assert loss([1] * 4, [1, 1, 0, 0]) == pytest.approx(lse([2, 1, 0.5, -1]) - lse([2, 1]))
    assert loss([1, 1, 0, 0], [1, 0, 0, 0]) == pytest.approx(lse([2, 1]) - 2) and loss([1] * 4, [0] * 4) is None


def test_registry_and_events(spark):
    reg = spark.createDataFrame([("v1", 1, True), ("v2", 2, False)], "version string, created_at int, promoted boolean")
    new = spark.createDataFrame([("v2", 3)], "version string, created_at int")
    out = {r.version: r for r in replay.add_version(reg, new, True).collect()}
    assert len(out) == 2 and out["v2"].promoted and not out["v1"].promoted and out["v2"].created_at == 3
    e = spark.createDataFrame([(("generated_code", 1, "x" * 900, "q"),), (("other", 2, "code", "q"),)], "e struct<event:string,depth:int,code:string,query:string>")
    got = [r.c for r in e.select(replay.compact_event(F.col("e"), ["event", "depth", "code", "query"]).alias("c")).collect()]
    assert len(got[0].code) == 800 and got[0].query is None and got[1].code is None and got[1].query == "q"


def test_navigation_reaches_the_right_leaf(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TOY)], "doc_id long, text string")
    members = spark.createDataFrame([(0, "a.x"), (1, "a.y"), (2, "b.x"), (3, "b.y")], "doc_id long, node_id string")
    asked = spark.createDataFrame([(1, "pasta sauce with basil")], "query_id long, text string")
    visited = navigate.heuristic(asked, tree.nodes_of(members), navigate.cards(docs, members), branches=1)
    assert [r.node_id for r in visited.collect()] == ["b.x"]
    assert [r.doc_id for r in navigate.retrieve(asked, docs, members, visited, 5).collect()] == [2]


def test_negatives(spark):
    from arborist.operators import negatives

    rows = spark.createDataFrame(
        [(1, 10, ["a", "b", "c", "d", ""], [1, 1, 1, 1, 0], [0, 0, 0, 1, 0], [4.0, 3.0, 2.0, 1.0, 9.0], 0, ["a"]), (2, 20, ["x", "y", "", "", ""], [1, 1, 0, 0, 0], [1, 0, 0, 0, 0], [4.0, 3.0, 0.0, 0.0, 0.0], 0, ["d"])],
        "row_id int, query_id int, candidates array<string>, mask array<int>, positive array<int>, scores array<double>, batch int, path array<string>",
    )
    near = spark.createDataFrame([(10, "a", 1), (10, "z", 2), (10, "w", 3), (20, "q", 1)], "query_id int, node_id string, rank int")
    out = negatives.hard_negatives(rows, near).collect()
    assert [(r.row_id, r.candidates, r.mask, r.positive, r.added) for r in out] == [(1, ["a", "b", "c", "d", "z"], [1] * 5, [0, 0, 0, 1, 0], 1)]
    both = {r.row_id: r for r in negatives.batch_negatives(rows, "batch", "path").collect()}
    assert both[1].candidates == ["a", "b", "c", "d", "x"] and both[2].candidates == ["x", "y", "", "", ""]
    one = spark.createDataFrame([(["c0.0", "c0.1", "c1", ""], [1, 1, 1, 0], [1, 0, 0, 0], "c0", ["root", "c0.1", "c0"])], "c array<string>, m array<int>, p array<int>, n string, path array<string>")
    assert one.select(negatives.loop_mask(*(F.col(x) for x in ("c", "m", "p", "n", "path"))).alias("l")).first().l == [0, 1, 0, 0]


def test_index_round_trip_and_stream(spark, tmp_path):
    from arborist.sources import index_store
    from arborist.streaming.promotion import promotion_stream

    docs = spark.createDataFrame(TOY, "doc_id string, text string")
    members = spark.createDataFrame([(d, "c0" if i < 2 else "c1") for i, (d, _) in enumerate(TOY)], "doc_id string, node_id string")
    index_store.save(str(tmp_path / "i"), hierarchy.BuildConfig(branching=2), docs, tree.nodes_of(members), members)
    config, tables = index_store.load(spark, str(tmp_path / "i"))
    assert config.branching == 2 and tables["documents"].count() == 4 and tables["nodes"].count() == 3 and "embeddings" not in tables
    rows = spark.createDataFrame([("t1", 0.9), ("t2", 0.1)], "trajectory_id string, score double")
    assert index_store.append_json(rows, str(tmp_path / "r")) == 2
    held: list[float] = []
    for _ in range(2):
        promotion_stream(spark, str(tmp_path / "r"), "trajectory_id string, score double", str(tmp_path / "c"), lambda df: df.agg(F.avg("score")).first()[0], lambda: held[-1] if held else None, held.append).awaitTermination()
    assert held == [0.5]  # a second run finds nothing new


def test_svg(spark):
    from arborist.operators import svg

    nodes = tree.nodes_of(spark.createDataFrame([("a.x",), ("a.y",)], "node_id string")).withColumn("label", F.lit("one <two> three"))
    text = svg.render(nodes)
    assert text.count("<rect") == 4 and text.count("<path") == 3 and "&lt;two&gt;" in text
    assert svg.wrap("aa bb cc dd", 5, 1) == ["aa..."] and svg.wrap("", 5, 2) == []


def test_stores_of_vectors_weights_and_runs(spark, tmp_path):
    import json

    import numpy as np

    from arborist.operators import policy
    from arborist.sources import index_store as S

    vectors = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.0, -2.0])], "query_id long, embedding array<double>")
    S.save_vectors(vectors, "query_id", f"{tmp_path}/v")
    assert {r.query_id: list(r.embedding) for r in S.load_vectors(spark, f"{tmp_path}/v", 2).collect()} == {1: [0.5, 1.0], 2: [0.0, -2.0]}
    assert S.load_vectors(spark, f"{tmp_path}/v", 3) is None
    weights = policy.init_weights(policy.PolicyConfig(dim=4, hidden=6, scorer=3), 5)
    S.save_weights(spark, weights, f"{tmp_path}/w", {"phase": 1})
    back, notes = S.load_weights(spark, f"{tmp_path}/w")
    assert notes["phase"] == 1 and set(back) == set(weights) and all(np.array_equal(back[k], weights[k]) for k in weights)
    name = next(iter(weights))
    other = S.save_weights(spark, {**weights, name: weights[name] + 1}, f"{tmp_path}/x")
    assert other != notes["sha256"]
    spark.read.parquet(f"{tmp_path}/x/weights").write.mode("overwrite").parquet(f"{tmp_path}/w/weights")
    with pytest.raises(ValueError):
        S.load_weights(spark, f"{tmp_path}/w")
    S.save_run(f"{tmp_path}/run", vectors, vectors.limit(1), {"ndcg": 0.5})
    assert spark.read.json(f"{tmp_path}/run/results").count() == 2 and json.loads(spark.read.text(f"{tmp_path}/run/summary").first().value) == {"ndcg": 0.5}
