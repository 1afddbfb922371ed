"""Navigation of a tree by its nodes' cards, then lexical ranking of what was reached.

Queries are rows: a frontier (query_id, node_id, path) goes down one level a join, so there are as many joins as levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords, label, overlap, tokens
from .lexical import Bm25, Postings, within_budget
from .tree import ROOT, path_nodes


def cards(docs: DataFrame, members: DataFrame, words: int = 8) -> DataFrame:
    """(node_id, label, summary, keywords) of every node but the root, from its documents' most frequent keywords.

    Words are counted by leaf before they are added up for the nodes above.
    """
    by_leaf = docs.join(members, "doc_id").select("node_id", F.explode(keywords(F.col("text"))).alias("word")).groupBy("node_id", "word").agg(F.count("*").alias("n"))
    rows = by_leaf.select(F.explode(path_nodes(F.col("node_id"))).alias("node_id"), "word", "n").where(F.col("node_id") != ROOT)
    rows = rows.groupBy("node_id", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.col("n").desc(), "word"))
    top = rows.withColumn("r", place).where(F.col("r") <= words).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("w"))
    top = top.select("node_id", F.transform("w", lambda x: x["word"]).alias("keywords"))
    summary = F.concat(F.lit("Documents about "), F.array_join("keywords", ", "), F.lit("."))
    return top.select("node_id", label(F.col("keywords"), F.col("node_id")).alias("label"), summary.alias("summary"), "keywords")


def heuristic(queries: DataFrame, nodes: DataFrame, cards_: DataFrame, branches: int = 2, first: int = 8, clusters: int = 8, max_depth: int | None = None, budget: int = 800) -> DataFrame:
    """(query_id, node_id, place): from the root, the `branches` best cards among the first `first` children whose summaries
    fit the budget of tokens, level by level, at most max_depth of them; the nodes reached in the order of a depth-first walk,
    the first `clusters` of them.

    That equals stopping a sequential walk at its cap, as decisions don't depend on what was visited.
    """
    child = nodes.where(F.col("parent_id").isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy("parent_id").orderBy("node_id"))).where(F.col("nth") <= first)
    shown = within_budget(child.join(cards_, "node_id"), ["parent_id"], ["nth"], "summary", budget)
    scored = shown.select("parent_id", F.col("node_id").alias("child"), "nth", tokens(F.concat_ws(" ", "label", "summary", F.array_join("keywords", " "))).alias("card"))
    depth = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    depth = depth if max_depth is None else min(depth, max_depth)
    at = queries.select("query_id", tokens(F.col("text")).alias("q"), F.lit(ROOT).alias("node_id"), F.array().cast("array<int>").alias("path"))
    for _ in range(depth):
        step = at.join(scored.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
        step = step.withColumn("s", F.round(overlap(F.col("q"), F.coalesce("card", F.array().cast("array<string>"))), 9))
        order = Window.partitionBy("query_id", "node_id").orderBy(F.col("s").desc(), F.col("nth"))
        best = step.withColumn("r", F.row_number().over(order)).where(F.col("r") <= branches)
        at = best.select("query_id", "q", F.coalesce("child", "node_id").alias("node_id"), F.when(F.col("child").isNull(), F.col("path")).otherwise(F.concat("path", F.array("r"))).alias("path"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("path", "node_id"))
    return at.select("query_id", "node_id", place.cast("bigint").alias("place")).where(F.col("place") <= clusters)


def retrieve(queries: DataFrame, docs: DataFrame | Postings, members: DataFrame, visited: DataFrame, limit: int) -> DataFrame:
    """BM25 with corpus-wide statistics among the documents of the visited nodes."""
    candidates = visited.select("query_id", "node_id").join(members, "node_id").select("query_id", "doc_id")
    return Bm25().top(docs, queries, limit, candidates)
