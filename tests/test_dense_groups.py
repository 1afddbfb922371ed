"""Dense search in groups: exact, with ties, nulls, strings as ids, and queries and items dealt to several groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.operators import dense as D
from arborist.operators import policy as P
from arborist.operators import supervision as V
from arborist.operators.lexical import ranked


@pytest.fixture()
def small_groups(monkeypatch):
    monkeypatch.setattr(D, "GROUP_QUERIES", 7)
    monkeypatch.setattr(D, "GROUP_ITEMS", 40)
    monkeypatch.setattr(D, "AT_ONCE", 16)


def vectors(spark, n, seed, copies=1):
    rng = np.random.RandomState(seed)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.repeat(rng.randn(n, 8), copies, 0))]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>")


def same(a, b, names):
    rows = [sorted(map(tuple, x.select(*names).collect()), key=str) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_pairs_are_no_rows(spark):
    items = vectors(spark, 50, 1)
    found = D.top(items.withColumnRenamed("doc_id", "query_id"), items, 3)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("copies", [1, 12])
def test_equal_to_all_pairs(spark, small_groups, copies):
    items = vectors(spark, 120 // copies, 2, copies).unionByName(spark.createDataFrame([(900, None), (901, [1.0, 2.0]), (902, [0.0] * 8), (903, [None] * 8), (904, [float("nan")] * 8)], "doc_id long, embedding array<float>"))
    asked = items.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    own = asked.select("query_id", F.col("query_id").alias("doc_id"))
    for k in (1, 6, 500):
        want = ranked(D.scores(asked, items).join(own, ["query_id", "doc_id"], "left_anti"), "query_id", "score", "doc_id", k)
        same(D.top(asked, items, k, exclude=own).fillna(9.0).replace(float("nan"), 5.0), want.fillna(9.0).replace(float("nan"), 5.0), ["query_id", "doc_id", "score", "rank"])


def test_within_a_key_and_named_items(spark, small_groups):
    items = vectors(spark, 150, 3).select(F.concat(F.lit("n"), "doc_id").alias("name"), "embedding", (F.col("doc_id") % 3).alias("part"))
    asked = vectors(spark, 30, 4).select(F.col("doc_id").alias("query_id"), "embedding", F.explode(F.array((F.col("doc_id") % 2).cast("long"), F.lit(7).cast("long"))).alias("part"))
    pairs = D.pair_scores(asked.select("query_id", "part").join(items.select("part", "name"), "part"), asked.dropDuplicates(["query_id"]), items, "name").join(items.select("name", "part"), "name")
    want = ranked(pairs.join(asked.select("query_id", "part"), ["query_id", "part"]), ["query_id", "part"], "score", "name", 4)
    same(D.top_within(asked, items, 4, ["part"], "name"), want, ["query_id", "part", "name", "score", "rank"])


def test_empty_tables(spark):
    items = vectors(spark, 5, 5)
    asked = items.withColumnRenamed("doc_id", "query_id")
    assert D.top(asked.limit(0), items, 3).count() == D.top(asked, items.limit(0), 3).count() == 0


def test_block_of_a_node(spark, small_groups):
    items = vectors(spark, 150, 6).withColumn("node_id", F.concat(F.lit("n"), F.col("doc_id") % 2))
    asked = vectors(spark, 9, 7).withColumnRenamed("doc_id", "query_id")
    relevant = asked.select("query_id", F.explode(F.array(F.col("query_id"), F.col("query_id") + 60, F.lit(999).cast("long"))).alias("doc_id"))
    targets = asked.select("query_id", F.explode(F.array(F.lit("n0"), F.lit("n1"), F.lit("gone"))).alias("node_id"))
    scores = D.pair_scores(targets.join(items, "node_id").select("query_id", "doc_id"), asked, items)
    want = V.retrieve_block(targets, items.select("doc_id", "node_id"), relevant, scores, 4)
    same(V.nearest_block(targets, items, relevant, asked, 4), want, ["query_id", "node_id", "doc_id", "positive", "place"])


def test_documents_of_a_state_carry_no_pairs(spark):
    items = vectors(spark, 40, 8)
    features = spark.createDataFrame([("a", 40, True)], "node_id string, n_docs long, is_leaf boolean")
    states = items.limit(3).select(F.col("doc_id").alias("query_id"), F.lit("a").alias("node_id"), F.col("embedding").cast("array<double>").alias("q"))
    found = P._node_documents(states, features, items.select("doc_id", F.lit("a").alias("node_id")), items, P.RolloutConfig(documents=5))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert all(len(r.documents) == 5 for r in found.collect())


def table(name, rows, first=0):
    import pyarrow as pa

    return pa.table({name: pa.array(range(first, first + len(rows)), pa.int64()), "_v": pa.array([None if r is None else [float(x) for x in r] for r in rows], pa.list_(pa.float32()))})


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_few_pairs_are_computed_again(monkeypatch, limit):
    """Of copies and of all others only what can be among the first is looked at in double precision."""
    rng, seen = np.random.RandomState(9), [0]
    rows = rng.randn(3000, 16).astype(np.float32)
    rows[1000:2500] = rows[7]
    asked = np.concatenate([rows[:20], rng.randn(20, 16)]).astype(np.float32)
    queries, items = table("query_id", asked), table("doc_id", rows, 100)
    plain = D._dots
    monkeypatch.setattr(D, "_dots", lambda a, b: (seen.__setitem__(0, seen[0] + len(a)), plain(a, b))[1])
    found = D._nearest(limit, ["query_id"], "doc_id")(queries, items).to_pydict()
    assert seen[0] <= len(asked) + len(rows) + 4 * limit * len(asked) + 100  # each vector's length, and the first
    unit = [x.astype(float) / np.sqrt(plain(x.astype(float), x.astype(float)))[:, None] for x in (asked, rows)]
    want = []
    for k, v in enumerate(unit[0]):
        s = plain(np.tile(v, (len(rows), 1)), unit[1])
        want += [(k, 100 + i, s[i]) for i in np.lexsort((np.arange(len(rows)), -np.round(s, 9)))[:limit]]
    assert sorted(zip(found["query_id"], found["doc_id"], found["score"])) == sorted(want)


def test_nearly_equal_vectors_and_numbers_of_items(monkeypatch):
    monkeypatch.setattr(D, "_MANY", 10)
    monkeypatch.setattr(D, "_NUMBERS", 700)
    rng = np.random.RandomState(10)
    near = (np.ones((1500, 8)) + rng.randn(1500, 8) * 1e-6).astype(np.float32)
    rows = [None, [1.0, 2.0], *near, [float("nan")] * 8]
    asked = [near[3], None, [2.0, 1.0], near[9] * 2]
    for asked_ in (asked, asked[1:2]):
        found = D._nearest(6, ["query_id"], "doc_id", 64, 2)(table("query_id", asked_), table("doc_id", rows)).to_pydict()
        old = D._masked(*D._unit(table("query_id", asked_)["_v"].chunk(0), 8, -1), *D._unit(table("doc_id", rows)["_v"].chunk(0), 8, -2), np.arange(len(rows)), 6, 64)
        want = sorted(zip(old[0].tolist(), old[1].tolist(), old[2].tolist()), key=str)
        got = sorted(((q, i, -np.inf if s is None else s) for q, i, s in zip(found["query_id"], found["doc_id"], found["score"])), key=str)
        assert str(got) == str(want)


def test_larger_groups_move_less(spark, monkeypatch):
    """Items go to as few groups of queries as cores need, not to one of every 2,048 queries."""
    monkeypatch.setattr(D, "_nearest", lambda limit, asked, item, *_: lambda q, i: q.slice(0, 1).select(asked).append_column(item, [[i.num_rows]]).append_column("score", [[float(q.num_rows)]]))
    asked = spark.range(9000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("embedding"))
    found = D.top_within(asked, asked.withColumnRenamed("query_id", "doc_id"), 5, []).collect()
    assert sum(r.doc_id for r in found) < 4 * 9000


def test_few_pairs_are_one_group(spark, monkeypatch):
    """A group's first pairs cost most, so some millions of pairs aren't split for every core."""
    monkeypatch.setattr(D, "_nearest", lambda limit, asked, item, *_: lambda q, i: q.slice(0, 1).select(asked).append_column(item, [[i.num_rows]]).append_column("score", [[float(q.num_rows)]]))
    asked, items = (spark.range(5000).select(F.col("id").alias(name), F.array(F.lit(1.0)).alias("embedding"), (F.col("id") % 2).alias("part")) for name in ("query_id", "doc_id"))
    assert [(r.doc_id, r.score) for r in D.top_within(asked, items, 5, []).collect()] == [(5000, 5000.0)]
    assert [(r.doc_id, r.score) for r in D.top_within(asked, items, 5, ["part"]).collect()] == [(2500, 2500.0)] * 2
