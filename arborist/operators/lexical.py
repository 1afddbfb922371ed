"""Lexical retrieval: BM25 with corpus-wide statistics, and token overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap, tokens
from ..sources.layout import spread
from . import postings
from .postings import Postings, idf


def ranked(rows: DataFrame, by: str | list[str], score: str, tie: str, limit: int | None = None) -> DataFrame:
    """rows with `rank` from 1 by rounded score, ties by the id; only the first limit."""
    order = Window.partitionBy(by).orderBy(F.round(F.col(score), 9).desc(), F.col(tie).asc())
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def positive_first(rows: DataFrame, by: str, score: str, tie: str, limit: int) -> DataFrame:
    """The first limit rows by score, as ranked(); if any of a group's scores is positive, only such rows.

    Scores that aren't positive rank last, so they are left out after the limit, which Spark applies before the shuffle.
    """
    top = ranked(rows, by, score, tie, limit)
    first = F.max(score).over(Window.partitionBy(by).orderBy("rank"))
    return top.withColumn("_most", first).where((F.col("_most") <= 0) | (F.col(score) > 0)).drop("_most")


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    floor: float = 0.25  # terms of negative idf get this share of the mean idf

    def term_stats(self, docs: DataFrame | Postings) -> DataFrame:
        """(term, df, idf) over all documents."""
        index = _index(docs)
        return index.terms().select("term", "df", idf(index, self.floor).alias("idf"))

    def scores(self, docs: DataFrame | Postings, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) of all pairs that share a term, from an index (built of docs if it is a table).

        within (doc_id, or query_id and doc_id) restricts what is given; statistics stay the corpus's.
        """
        return postings.scores(_index(docs), queries, self.k1, self.b, self.floor, within)

    def first(self, docs: DataFrame | Postings, queries: DataFrame, limit: int, within: DataFrame | None = None) -> DataFrame:
        """scores() of as many pairs as hold each query's first `limit`, whatever their sign."""
        return postings.best(_index(docs), queries, self.k1, self.b, self.floor, limit, within)

    def top(self, docs: DataFrame | Postings, queries: DataFrame, limit: int, candidates: DataFrame | None = None) -> DataFrame:
        """Ranked (query_id, doc_id, score, rank); candidates (query_id, doc_id) restrict what is ranked, not the statistics."""
        if candidates is None:
            found = postings.best(_index(docs), queries, self.k1, self.b, self.floor, limit)
        else:
            pairs = candidates.select("query_id", "doc_id").distinct()
            found = pairs.join(self.scores(docs, queries, pairs), ["query_id", "doc_id"], "left").fillna(0.0, ["score"])
        return positive_first(found, "query_id", "score", "doc_id", limit)


def _index(docs: DataFrame | Postings) -> Postings:
    return docs if isinstance(docs, Postings) else postings.build(docs)


def overlap_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the share of a query's distinct tokens that a document has, of pairs that share one."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    words = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    hits = asked.select("query_id", F.size("q").alias("n"), F.explode("q").alias("term")).join(words, "term")
    return hits.groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("shared")).select("query_id", "doc_id", (F.col("shared") / F.col("n")).alias("score"))


def card_score(query: Column, *parts: Column) -> Column:
    """Overlap of a query's tokens with those of a node's label, summary and keywords."""
    return overlap(tokens(query), tokens(F.concat_ws(" ", *parts)))


def within_budget(cards: DataFrame, by: list[str], order: list[str], summary: str, budget: int) -> DataFrame:
    """The first cards whose summaries have at most 5 characters a token of budget, summed; lengths aren't negative, so
    a running sum finds where to stop."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cards.withColumn("_used", F.sum(F.length(F.coalesce(F.col(summary), F.lit("")))).over(window)).where(F.col("_used") <= budget * 5).drop("_used")
