"""What only shows in larger tables, by what is handed on at small ones."""

from __future__ import annotations

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")


def test_only_questions_that_score_meet_their_leafs_documents(spark, monkeypatch):
    from arborist.operators import postings
    from arborist.plans import catalogue
    from arborist.sources import corpus

    given, scored = [], postings._scored

    def seen(index, asked, part, limit=None, within=None):
        given.append((within, limit))
        return scored(index, asked, part, limit, within)

    monkeypatch.setattr(postings, "_scored", seen)
    rows = catalogue.QUERIES["bm25_in_greedy_leaf"].run(spark, str(DATA)).collect()
    asked = {r.query_id for r in corpus.queries(spark, str(DATA)).where("query_id % 20 = 0").collect()}
    within, limit = given[-1]
    assert rows and limit == 10
    assert {r.query_id for r in rows} <= {r.query_id for r in within.select("query_id").distinct().collect()} <= asked


def test_training_rows_have_the_nearest_documents_without_all_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from arborist.functions.vector import dot, normalised
    from arborist.operators import supervision as V
    from arborist.plans import record_plans

    def plain(targets, members, relevant, queries, most):
        called.append(most)
        docs = members.select("doc_id", "node_id", normalised(F.col("embedding")).alias("v"))
        pairs = targets.join(docs, "node_id").join(queries.select("query_id", normalised(F.col("embedding")).alias("q")), "query_id")
        pairs = pairs.select("query_id", "doc_id", dot(F.col("q"), F.col("v")).alias("score")).distinct()
        return V.retrieve_block(targets, docs.select("doc_id", "node_id"), relevant, pairs, most)

    def rows():
        found = record_plans._rows(spark, str(DATA))[0].where("retrieve is not null").select("row_id", F.transform("retrieve", lambda x: F.struct(F.round(x["sim"], 9), x["p"])).alias("x"))
        return sorted((r.row_id, str(r.x)) for r in found.collect())

    called, got = [], rows()
    monkeypatch.setattr(V, "nearest_block", plain)
    assert len(got) > 10 and got == rows() and called
