"""Corpus, queries and judgements from the parquet tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import fingerprint, spread, stored

SHORT_BLOCK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark: SparkSession, sf_dir: str):
    """The stored postings of the documents, built once in an application."""
    from ..operators.postings import of_table

    return of_table(spark, f"{sf_dir}/documents.parquet")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, rel): documents that contain the query's text; rel is 1 and the document's quality label.

    Found once in an application, as long as the tables' files stay the same.
    """
    files = tuple(fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    return _judged(spark, spark.sparkContext.applicationId, files, sf_dir)


@functools.lru_cache(16)
def _judged(spark: SparkSession, _application: str, _files: tuple, sf_dir: str) -> DataFrame:
    """A containing text has all the query's tokens; so pairs are found by the postings of the query's rarest inner token
    (the first and the last may be cut out of longer ones), and only those are compared as texts.  Queries of one or two
    tokens, which may stand within longer ones, are compared with all texts, in blocks."""
    from ..functions.text import tokens
    from ..operators.postings import MOST_ASKED, matching

    docs, asked, postings = documents(spark, sf_dir).select("doc_id", "text"), queries(spark, sf_dir), index(spark, sf_dir)
    words = tokens(F.col("text"))
    inner = asked.select("query_id", F.explode(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).alias("term")).distinct()
    key = inner.join(postings.terms(), "term").groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("key")).select("query_id", F.col("key.term").alias("term"))
    pairs = stored(matching(postings, stored(key), "docs").select("query_id", F.explode("docs").alias("doc_id")))
    # pairs go to the texts, so these aren't moved, unless there are too many
    pairs = F.broadcast(pairs) if pairs.count() <= MOST_ASKED else pairs
    named = asked.withColumnRenamed("text", "asked")
    named = F.broadcast(named) if asked.count() <= SHORT_BLOCK else named
    found = spread(docs).join(pairs, "doc_id").join(named, "query_id").where(F.col("text").contains(F.col("asked"))).select("query_id", "doc_id")
    short = asked.where(F.size(words) < 3).withColumnRenamed("text", "asked")
    blocks = -(-short.count() // SHORT_BLOCK)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        found = found.unionByName(spread(docs).join(F.broadcast(block), F.col("text").contains(F.col("asked"))).select("query_id", "doc_id"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return stored(found.join(labels, "doc_id", "left").select("query_id", "doc_id", (F.lit(1) + F.coalesce("quality", F.lit(0))).cast("int").alias("rel")))


def evaluable(asked: DataFrame, judged: DataFrame) -> DataFrame:
    """Queries with a positive judgement, with their documents."""
    positive = judged.where(F.col("rel") > 0).groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return asked.join(positive, "query_id")
