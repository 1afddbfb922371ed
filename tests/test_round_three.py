"""Values as the SQL shows them, and scores of every card."""

from __future__ import annotations

from arborist.operators import evaluate as E
from arborist.plans import catalogue


def test_four_decimals_are_those_of_the_binary_value(spark):
    rows = [(i, 10, v, v, v, v, 0.0) for i, v in enumerate([0.30125, 0.59375, 0.00125, 0.03125])]
    names = "query_id long, k long, ndcg double, ap double, recall double, precision double, rr double"
    for row in rows:
        got = {r.metric: r.value for r in E.table(spark.createDataFrame([row], names)).collect()}
        assert got["P@10"] == "%.4f" % row[2], row


def test_every_card_has_a_score(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalogue.QUERIES["card_lexical_score"].run(spark, sf).collect()
    sources = spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().count()
    assert len(rows) == sources * spark.read.parquet(f"{sf}/benchmark.parquet").count() and any(r.score == 0 for r in rows)
