"""The stored index: BM25 in plain Python, blocks that are skipped without a loss, and no text that is read when asking."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from arborist.operators import postings as P
from arborist.operators.lexical import Bm25


def plain(docs, queries, k1=1.5, b=0.75, floor=0.25):
    tf = {i: collections.Counter(t.split()) for i, t in docs}
    n, mean = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = collections.Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    least = floor * sum(raw.values()) / len(raw)
    idf = {w: least if r < 0 else r for w, r in raw.items()}
    out = {}
    for q, text in queries:
        for i, c in tf.items():
            shared = [w for w in text.split() if w in c]
            if shared:
                size = sum(c.values())
                out[q, i] = sum(idf[w] * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * size / mean)) for w in shared)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 40)))) for i in range(600)]
    return docs, [(q, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for q in range(25)] + [(90, "unknown"), (91, "")]


def test_blocks_are_skipped_without_a_loss(spark, texts):
    docs, queries = texts
    rows, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string")
    index = P.build(rows, block_docs=20)
    want = plain(docs, queries)
    got = {(r.query_id, r.doc_id): r.score for r in Bm25().scores(index, asked).collect()}
    assert got == pytest.approx(want)
    top = collections.defaultdict(list)
    for r in Bm25().top(index, asked, 5).orderBy("query_id", "rank").collect():
        top[r.query_id].append(r.doc_id)
    for q, _ in queries:
        order = sorted((-round(s, 9), i) for (a, i), s in want.items() if a == q)
        order = [(s, i) for s, i in order if s < 0] or order
        assert top.get(q, []) == [i for _, i in order[:5]]
    scored = P.best(index, asked, 1.5, 0.75, 0.25, 5).count()
    assert scored < len(want)  # some blocks weren't looked at
    assert index.blocks().agg(F.max(F.size("docs"))).first()[0] <= 60


def test_what_is_restricted_is_scored_alone(spark, texts):
    docs, queries = texts
    rows, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string")
    index = P.build(rows, block_docs=50)
    want = plain(docs, queries)
    some = spark.createDataFrame([(q, i) for q in range(9) for i in range(q, 600, 7)], "query_id bigint, doc_id bigint")
    got = {(r.query_id, r.doc_id): r.score for r in Bm25().scores(index, asked, some).collect()}
    assert got == pytest.approx({(q, i): s for (q, i), s in want.items() if q < 9 and i >= q and (i - q) % 7 == 0})
    ranked = Bm25().top(index, asked, 3, some.where("query_id = 0 and doc_id < 60")).collect()
    assert len(ranked) == 3


def test_texts_are_read_when_building_alone(spark, texts, tmp_path):
    docs, queries = texts
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(at)
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    index = P.of_table(spark, at)
    assert P.of_table(spark, at) is index
    top = Bm25().top(index, asked, 5)
    assert at not in top._jdf.queryExecution().executedPlan().toString() and not any(f"{tmp_path}/documents" in f for f in top.inputFiles())
    spark.createDataFrame(docs[:9], "doc_id bigint, text string").write.mode("append").parquet(at)
    assert P.of_table(spark, at).n == len(docs) + 9


def test_odd_tables(spark):
    empty = P.build(spark.createDataFrame([], "doc_id bigint, text string"))
    asked = spark.createDataFrame([(1, "a b"), (2, None)], "query_id bigint, text string")
    assert Bm25().top(empty, asked, 3).collect() == [] and Bm25().term_stats(empty).collect() == []
    rows = spark.createDataFrame([(None, "a a"), (5, None), (6, ""), (7, "A, b!")], "doc_id bigint, text string")
    index = P.build(rows)
    assert index.n == 4 and index.mean == 1.0
    assert {(r.doc_id, r.term, r.tf) for r in index.blocks().select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("x")).select("term", F.col("x.docs").alias("doc_id"), F.col("x.tfs").alias("tf")).collect()} == {(None, "a", 2), (7, "a", 1), (7, "b", 1)}


def test_blocks_stay_where_they_are(spark, texts):
    docs, queries = texts
    index = P.build(spark.createDataFrame(docs, "doc_id bigint, text string"), block_docs=20)
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    plan = Bm25().scores(index, asked, spark.range(9).withColumnRenamed("id", "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [term" in plan and "hashpartitioning(term" not in plan


def test_blocks_are_bounded_by_tokens(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "BLOCK_TOKENS", 6)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * n for n in (2, 9, 0, 3, 3, 1)])], ["doc_id", "tokens"])
    assert [part.column("doc_id").to_pylist() for part in P._blocks(batch, 4)] == [[0], [1], [2, 3, 4], [5]]


def test_rows_of_one_id_score_together(spark, monkeypatch):
    rows = [(i % 40, f"a w{i}") for i in range(80)]
    index = P.build(spark.createDataFrame(rows, "doc_id bigint, text string"), block_docs=3)
    top = Bm25().top(index, spark.createDataFrame([(1, "w7 w47")], "query_id bigint, text string"), 1).collect()
    assert index.repeated and [r.doc_id for r in top] == [7] and len(index.blocks().where("term = 'w7' or term = 'w47'").collect()) == 2


def test_a_block_gives_few_pairs(spark, texts):
    """A top-k search moves postings and a block's first, not a row for each query and document."""
    docs, queries = texts
    rows, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string")
    index = P.build(rows, block_docs=100)
    within = rows.where("doc_id % 3 = 0").select("doc_id")
    want, blocks = plain(docs, queries), index.places().select("block").distinct().count()
    for given, kept in ((None, want), (within, {k: s for k, s in want.items() if k[1] % 3 == 0})):
        got = {(r.query_id, r.doc_id): r.score for r in Bm25().first(index, asked, 4, given).collect()}
        assert got == pytest.approx({k: kept[k] for k in got}) and len(got) <= 4 * len(queries) * blocks and len(got) < len(kept)
        for q, _ in queries:
            first = sorted((-round(s, 9), i) for (a, i), s in kept.items() if a == q)[:4]
            assert {i for _, i in first} <= {i for a, i in got if a == q}
    plan = Bm25().first(index, asked, 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(block" in plan


def test_slices_of_queries_and_shared_terms(spark, texts, monkeypatch):
    from arborist.operators.lexical import overlap_scores, ranked

    monkeypatch.setattr(P, "SLICE", 7)
    docs, queries = texts
    rows, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string")
    index = P.build(rows, block_docs=50)
    pairs = spark.createDataFrame([(q, i) for q in range(9) for i in range(q, 600, 7)], "query_id bigint, doc_id bigint")
    want = plain(docs, queries)
    got = {(r.query_id, r.doc_id): r.score for r in Bm25().scores(index, asked, pairs).collect()}
    assert got == pytest.approx({(q, i): s for (q, i), s in want.items() if q < 9 and i >= q and (i - q) % 7 == 0})
    a, b = (sorted(map(tuple, ranked(x, "query_id", "score", "doc_id", 5).collect())) for x in (overlap_scores(rows, asked), P.shared_terms(index, asked, 5)))
    assert a == b and a


def test_places_hold_every_document(spark):
    index = P.build(spark.createDataFrame([(1, "a b"), (2, None), (3, "!"), (None, "c")], "doc_id bigint, text string"), block_docs=2)
    assert sorted(str(r.doc_id) for r in index.places().collect()) == ["1", "2", "3", "None"] and index.terms().where("term is null").isEmpty()


def test_judgements_do_not_move_texts(spark, tmp_path, monkeypatch):
    from arborist.sources import corpus as C

    docs = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 12))) for i in range(300)]
    asked = [(i, " ".join(docs[7 * i][1].split()[2:7])) for i in range(20)] + [(50, "w1")]
    for name, rows, kind in (("documents", docs, "doc_id bigint, text string"), ("benchmark", asked, "item_id bigint, text string"), ("labels", [(3, 1)], "doc_id bigint, quality int")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    plans, plain_stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain_stored(df))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are large
    try:
        got = {(r.query_id, r.doc_id) for r in C.judgements(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(q, i) for q, text in asked for i, whole in docs if text in whole} and got
    assert "BroadcastHashJoin [doc_id" in plans[-1]
    assert all("LeftOuter" in line for line in plans[-1].splitlines() if "SortMergeJoin" in line)  # labels alone
