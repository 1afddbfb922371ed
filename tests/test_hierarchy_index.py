"""A hierarchy as one product, from texts to saved tables, and input that can't be built."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arborist.operators import hierarchy as H
from arborist.sources import index_store
from arborist.sources.encoders import Encoder

CONFIG = H.BuildConfig(branching=3, max_depth=2, min_leaf=2, max_leaf=12, iterations=4)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    topics = [[f"{t}{i}" for i in range(9)] for t in ("cat", "car", "sea")]
    rows = [(i, " ".join(rng.choices(topics[i % 3], k=20)), "Title" if i % 2 else None) for i in range(45)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, title string").repartition(3)


def test_from_texts_to_saved_tables(spark, docs, tmp_path):
    built = H.index(docs, Encoder("hashed", 32), config=CONFIG)
    nodes, members = built["nodes"].collect(), built["members"]
    by_id = {r.node_id: r for r in nodes}
    assert by_id["root"].n_docs == 45 and len(nodes) > 3 and all(r.label for r in nodes if r.node_id != "root")
    # every level holds all documents of what is below, and centroids are of length 1
    counts = {r.node_id: r["count"] for r in members.groupBy("node_id").count().collect()}
    assert counts == {r.node_id: r.n_docs for r in nodes}
    assert all(abs(sum(x * x for x in r.centroid) - 1) < 1e-9 for r in nodes)
    index_store.save(f"{tmp_path}/index", CONFIG, built["documents"], built["nodes"], members, built["embeddings"])
    config, loaded = index_store.load(spark, f"{tmp_path}/index")
    assert config == CONFIG and loaded["nodes"].count() == len(nodes) and loaded["embeddings"].count() == 45


def test_input_that_cannot_be_built(spark, docs):
    vectors = docs.select("doc_id", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    for odd, given, what in (
        (docs.where("false"), vectors, "no documents"),
        (docs.union(docs.limit(1)), vectors, "recur"),
        (docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))), vectors, "null"),
        (docs, vectors.where("doc_id > 3"), "45 documents have 41 vectors"),
        (docs, vectors.withColumn("embedding", F.when(F.col("doc_id") == 5, F.array(F.lit(1.0))).otherwise(F.col("embedding"))), "1 to 2 numbers"),
    ):
        with pytest.raises(ValueError, match=what):
            H.index(odd, vectors=given, config=CONFIG)
    with pytest.raises(ValueError, match="no documents"):
        H.index(docs.where("false"), Encoder("hashed", 8))
