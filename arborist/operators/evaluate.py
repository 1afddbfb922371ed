"""Ranking metrics.  Runs are (query_id, doc_id, score), judgements (query_id, doc_id, rel) with rel above 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import ranked

CUTS = (1, 3, 5, 10, 100, 1000)


def gain(rel):
    return F.pow(F.lit(2.0), rel) - 1


def per_query(run: DataFrame, judged: DataFrame, cuts=CUTS, binary: bool = False) -> DataFrame:
    """(query_id, k, ndcg, ap, recall, precision, rr) of queries that both tables have; all cuts in one pass."""
    judged = judged.where(F.col("rel") > 0)
    value = (lambda r: F.when(r > 0, 1.0).otherwise(0.0)) if binary else gain
    run = ranked(run.join(judged.select("query_id").distinct(), "query_id", "left_semi"), "query_id", "score", "doc_id")
    rows = run.join(judged, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    hit = (F.col("rel") > 0).cast("int")
    rows = rows.withColumn("hit", hit).withColumn("hits", F.sum(hit).over(Window.partitionBy("query_id").orderBy("rank")))
    k = F.explode(F.array(*map(F.lit, cuts))).alias("k")
    discount = F.log2(F.col("rank") + 1.0)
    inside = F.col("rank") <= F.col("k")
    got = rows.select("*", k).groupBy("query_id", "k").agg(
        F.sum(F.when(inside, value(F.col("rel")) / discount).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(inside & (F.col("hit") == 1), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("found"),
        F.sum(F.when(inside, 1).otherwise(0)).alias("shown"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    best = judged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id")))
    ideal = best.select("*", k).groupBy("query_id", "k").agg(
        F.sum(F.when(F.col("place") <= F.col("k"), value(F.col("rel")) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("idcg"), F.count("*").alias("relevant")
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return got.join(ideal, ["query_id", "k"]).select(
        "query_id", F.col("k").cast("bigint").alias("k"), share("dcg", "idcg").alias("ndcg"), share("precisions", "relevant").alias("ap"),
        share("found", "relevant").alias("recall"), share("found", "shown").alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def means(metrics: DataFrame) -> DataFrame:
    """Means over queries by cut."""
    return metrics.groupBy("k").agg(*(F.avg(c).alias(c) for c in ("ndcg", "ap", "recall", "precision", "rr")), F.count("*").alias("queries"))


def deltas(a: DataFrame, b: DataFrame, metric: str = "ndcg") -> DataFrame:
    """(query_id, a, b, delta): a query that one side lacks has 0 there."""
    both = a.select("query_id", F.col(metric).alias("a")).join(b.select("query_id", F.col(metric).alias("b")), "query_id", "full")
    a0, b0 = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.select("query_id", a0.alias("a"), b0.alias("b"), (a0 - b0).alias("delta"))


EDGES = (-1.0, -0.5, -0.2, -0.05, 0.0, 0.05, 0.2, 0.5, 1.0)


def histogram(rows: DataFrame, value: str, edges=EDGES) -> DataFrame:
    """(bin, n) from 0; bins are closed on the left, the last on both sides; values outside have none."""
    v, last = F.col(value), len(edges) - 2
    bucket = F.when(v == edges[-1], last)
    for i in range(last + 1):
        bucket = bucket.when((v >= edges[i]) & (v < edges[i + 1]), i)
    return rows.select(bucket.cast("bigint").alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"))


def rank_scores(run: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of a ranked run without scores of its own: one over the rank."""
    return run.select("query_id", "doc_id", (1.0 / F.col("rank")).alias("score"))


def extremes(rows: DataFrame, value: str, tie: str, most: int) -> DataFrame:
    """(kind, place, tie, value): the `most` largest ("win") and smallest ("loss") values; ties as one sorted list has them,
    read from its end for losses."""
    def first(kind, *order):
        top = rows.orderBy(*order).limit(most)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(kind).alias("kind"), "place", tie, value)

    return first("win", F.desc(value), F.asc(tie)).unionByName(first("loss", F.asc(value), F.desc(tie)))


def four_decimals(values: pd.Series) -> pd.Series:
    """As C's printf: the binary value itself is rounded, where Java's rounds the digits that it would show, halves up."""
    return values.map(lambda v: None if v is None else f"{v:.4f}")


def table(metrics: DataFrame) -> DataFrame:
    """(metric, value): means over queries by name and cut, to four decimals."""
    names = {"ndcg": "NDCG", "ap": "MAP", "recall": "Recall", "precision": "P"}
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for c, n in names.items()))
    rows = means(metrics).select("k", F.explode(pairs).alias("x"))
    return rows.select(F.concat("x.name", F.lit("@"), F.col("k").cast("string")).alias("metric"), F.pandas_udf(four_decimals, "string")("x.value").alias("value"))
