"""Traces folded event by event, by windows and as a stream; distillation; encoders, replay and registry."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.operators import traces as R
from arborist.operators import trainer as N
from arborist.operators import two_phase as P
from arborist.sources.encoders import Encoder, passage
from arborist.streaming.replay_sink import Registry, Replay, learn_stream

EVENTS = "trajectory_id string, seq bigint, event string, cluster_id string, docs array<bigint>, reward double"
NODES = ["root", "a", "a.x", "b"]


def events(n=40, seed=1):
    rng = random.Random(seed)
    out = []
    for t in range(n):
        for i in range(rng.randrange(9)):
            docs = None if rng.random() < 0.1 else [rng.randrange(6) for _ in range(rng.randrange(3))]
            out.append((f"t{t}", i if rng.random() < 0.9 else 0, rng.choice(["enter", "recurse", "search_in_cluster", "search_in_cluster", "return", "other"]), rng.choice([*NODES, "gone", None]), docs, [0.9, 0.2, None][t % 3] if t % 4 else 0.9))
    return out + out[:4]


def plain(rows, least=0.5):
    """Rows of each trajectory, by the fold over events that count."""
    by = {}
    for t, seq, event, node, docs, reward in rows:
        by.setdefault(t, [])
        docs = docs or []
        counts = event == "return" or node in NODES and (event in ("enter", "recurse") or event == "search_in_cluster" and docs)
        if reward is not None and reward >= least and counts:
            by[t].append((seq, event, node, docs))
    out = []
    for t, held in by.items():
        held.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or "", e[3]))
        out += [(t, *r) for r in R.fold(held)]
    return sorted(map(str, out))


def shown(df):
    return sorted(str((r.trajectory_id, r.step, r.node_id, r.action, r.target, list(r.evidence), r.retrieves, r.jumps, r.done)) for r in df.collect())


def test_a_trace_by_hand():
    rows = R.fold([(1, "enter", "a", []), (2, "recurse", "a.x", []), (3, "search_in_cluster", "b", [7, 7, 8]), (4, "return", None, [8, 9])])
    assert rows == [(0, "a", "JUMP", "a.x", [], 0, 0, False), (1, "b", "RETRIEVE", "b", [], 0, 1, False), (2, "b", "RETRIEVE", "b", [7, 8, 9], 1, 1, True)]
    assert R.fold([(1, "enter", "a", []), (2, "return", None, [4])]) == []


def test_windows_equal_the_fold(spark):
    nodes = spark.createDataFrame([(n,) for n in NODES], "node_id string")
    for seed in (1, 2):
        rows = events(seed=seed)
        got = R.convert(R.known(spark.createDataFrame(rows, EVENTS).repartition(3), nodes, 0.5))
        assert shown(got) == plain(rows) and len(plain(rows)) > 10
        assert all(r.path[-1] == r.node_id and r.path[0] == "root" for r in got.collect())
    assert R.convert(R.known(spark.createDataFrame([], EVENTS), nodes, 0.5)).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    """Events in files of some each; a trajectory's rows come when its end does."""
    nodes = spark.createDataFrame([(n,) for n in NODES], "node_id string")
    rows = events(12, 3)
    ends = [(t, 99, "end", None, None, 0.9) for t in sorted({r[0] for r in rows})]
    random.Random(4).shuffle(rows)
    schema = EVENTS + ", at timestamp"
    at = dt.datetime(2024, 1, 1)
    for part in (rows[:10], rows[10:], ends):
        spark.createDataFrame([(*r, at) for r in part], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    out = R.convert_stream(R.known(stream, nodes, 0.5)).writeStream.format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    out.awaitTermination()
    assert shown(spark.table("folded")) == plain(rows)


def test_distillation(spark):
    schema = "trajectory_id string, seq bigint, event string, query string, cluster_id string, code string, error string, docs array<bigint>"
    rows = [
        ("t", 1, "generated_code", None, None, "  x = 1\n", None, None), ("t", 2, "search_in_cluster", "q1", "c1", None, None, None), ("t", 3, "ground_query", "q1", None, None, None, None),
        ("t", 4, "sandbox_result", None, None, None, "e" * 600, None), ("t", 5, "generated_code", None, "c0", "x = 1", None, None), ("t", 6, "return", "no", None, None, None, list(range(30))), ("t", 7, "return", None, None, None, None, [3, 99]),
        ("t", 8, "generated_code", None, None, "y" * 2000, None, None), ("t", 9, "generated_code", None, None, "z", None, None), ("t", 10, "sandbox_result", None, None, None, "e" * 600, None), ("u", 1, "enter", "q", "", None, None, None),
    ]
    retrieved = spark.createDataFrame([("u", [5, 5, 6]), ("t", [1])], "trajectory_id string, docs array<bigint>")
    got = {r.trajectory_id: r for r in R.distill(spark.createDataFrame(rows, schema), retrieved).collect()}
    t, u = got["t"], got["u"]
    assert t.queries == ["q1"] and t.clusters == ["c1", "c0"] and t.docs == [*map(str, range(20)), "99"]
    assert t.snippets == ["x = 1", "x = 1", "y" * 1200] and t.errors == ["e" * 500] * 2
    assert (u.queries, u.clusters, u.docs, u.snippets, u.errors) == ([], [], ["5", "6"], [], [])


def test_encoder_encodes_what_is_new(spark, tmp_path):
    def factory():
        def model(texts):
            return np.array([[len(t), t.count("a")] for t in texts], float)

        return model

    encoder = Encoder("lengths", 2, factory, f"file://{tmp_path}/vectors")
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "doc_id bigint, text string")
    got, n = encoder.encode(rows, "doc_id")
    assert n == 3 and {r.doc_id: r.embedding for r in got.collect()} == {1: [2.0, 2.0], 2: [1.0, 0.0], 3: [2.0, 2.0], 4: [0.0, 0.0]}
    assert encoder.encode(rows, "doc_id")[1] == 0
    changed = rows.withColumn("text", F.when(F.col("doc_id") == 2, "new").otherwise(F.col("text")))
    got, n = encoder.encode(changed, "doc_id")
    assert n == 1 and {r.doc_id: r.embedding for r in got.collect()}[2] == [3.0, 0.0]
    other = Encoder("hashed", 8, None, encoder.folder)
    assert other.encode(rows, "doc_id")[1] == 3 and encoder.encode(rows, "doc_id")[1] == 0
    with pytest.raises(Exception, match="the encoder gave"):
        Encoder("bad", 3, factory, encoder.folder).encode(rows, "doc_id")
    titled = rows.withColumn("title", F.when(F.col("doc_id") == 1, "T"))
    assert [r[0] for r in titled.orderBy("doc_id").select(passage(titled)).collect()] == ["T\naa", "b", "aa", ""]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    schema = "trajectory_id string, score double"
    replay, registry = Replay(f"{tmp_path}/replay", schema), Registry(spark, f"file://{tmp_path}/registry")
    assert replay.load(spark).count() == 0 and registry.current() is None
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.7)], schema)
    for _ in range(2):
        replay.put(rows, 0)
    replay.extend(spark.createDataFrame([("c", 0.9)], schema))
    assert sorted(r.trajectory_id for r in replay.load(spark).collect()) == ["a", "b", "c"]
    for version, promote in (("v1", True), ("v2", True), ("v2", True), ("v3", False)):
        registry.add(version, 0.1, promote)
    assert [v["version"] for v in registry.versions()] == ["v1", "v2", "v3"] and registry.current()["version"] == "v2"
    assert sum(v["promoted"] for v in registry.versions()) == 1
    import os

    assert sorted(os.listdir(f"{tmp_path}/registry")) == [f for f in sorted(os.listdir(f"{tmp_path}/registry")) if "registry.json" in f]


def test_stream_learns_promotes_and_survives_a_failure(spark, tmp_path):
    """A real trainer; the second batch fails after it was stored, and is run again from the checkpoint."""
    from .test_trainer import WEIGHTS, frame, rows

    schema = "row_id bigint"
    replay, registry = Replay(f"{tmp_path}/replay", schema), Registry(spark, f"file://{tmp_path}/registry")
    data, failed = rows(120, 8), []
    for part in (range(60), range(60, 120)):
        spark.createDataFrame([(i,) for i in part], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def train(found):
        ids = {r.row_id for r in found.collect()}
        if len(ids) > 60 and not failed:
            failed.append(1)
            raise RuntimeError("lost")
        _, history = N.train(frame(spark, [r for r in data if r[0] in ids]), WEIGHTS, N.TrainConfig(epochs=1, batch_rows=60))
        return -float(history[-1]["loss"])

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        query = learn_stream(stream, replay, registry, train, f"{tmp_path}/ck")
        try:
            query.awaitTermination()
        except Exception as e:
            return str(e)
        return None

    assert "lost" in run() and [v["version"] for v in registry.versions()] == ["batch-0"]
    assert run() is None and [v["version"] for v in registry.versions()] == ["batch-0", "batch-1"]
    assert sorted(r.row_id for r in replay.load(spark).collect()) == list(range(120))
    assert registry.current() is not None and json.dumps(registry.versions())


def test_decisions_may_be_replaced(spark):
    """Replies decide; unknown targets fall back to the best cards, and RETRIEVE ends at the node."""
    nodes = spark.createDataFrame([("root", None, 0), ("a", "root", 1), ("b", "root", 1), ("a.x", "a", 2), ("a.y", "a", 2)], "node_id string, parent_id string, depth bigint")
    cards = spark.createDataFrame([(n, n, f"about {w}", [w]) for n, w in (("a", "cats"), ("b", "dogs"), ("a.x", "kittens"), ("a.y", "lions"))], "node_id string, label string, summary string, keywords array<string>")
    asked = spark.createDataFrame([(1, "kittens and cats"), (2, "dogs")], "query_id bigint, text string")
    walked = lambda **more: sorted(tuple(r) for r in P.walk(asked, nodes, cards, branches=1, **more).collect())
    assert walked() == [(1, "a.x", 1), (2, "b", 1)]
    reply = lambda text: lambda rows: rows.withColumn("reply", F.lit(text))
    assert walked(decide=P.by_reply(reply('{"action": "RETRIEVE"}'), 1)) == [(1, "root", 1), (2, "root", 1)]
    assert walked(decide=P.by_reply(reply('{"action": "JUMP", "targets": ["zzz", "a"]}'), 1)) == [(1, "a.x", 1), (2, "a.x", 1)]
    assert walked(decide=P.by_reply(reply("no json"), 1)) == walked()
    assert walked(max_depth=1) == [(1, "a", 1), (2, "b", 1)]
    members = spark.createDataFrame([(1, "a.x"), (2, "a.y"), (3, "b")], "doc_id bigint, node_id string")
    visited = spark.createDataFrame([(1, "a")], "query_id bigint, node_id string")
    near = spark.createDataFrame([(1, 1), (1, 3)], "query_id bigint, doc_id bigint")
    assert sorted(tuple(r) for r in P.pool(asked, visited, members, near).collect()) == [(1, 1, True, True), (1, 2, True, False), (1, 3, False, True), (2, 1, True, False), (2, 2, True, False), (2, 3, True, False)]
