"""Two-phase retrieval: a walk down the tree by a decision that may be replaced, then one ranking of all documents found.

The walk goes level by level for all queries at once.  At each node `decide` is asked with the children's cards; targets that
aren't children are dropped, and where none is left, the best cards by token overlap are taken.  Documents below the nodes that
were visited and, if asked for, a query's nearest documents make its pool, which keeps where a document came from.  Only the
pool is scored: by posting look-ups, and by the two vectors of each pair.

Cases: a query whose walk ends nowhere gets the root, so all documents; documents without a shared term score 0; without a
spread of scores in a pool the lexical part is 0; ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap, tokens
from . import dense as D
from .lexical import Bm25, Postings, ranked, within_budget
from .tree import ROOT, path_nodes

RETRIEVE, JUMP = "RETRIEVE", "JUMP"
#: Asked with (query_id, text, node_id, depth, cards); gives (query_id, node_id, action, targets).
Decide = Callable[[DataFrame], DataFrame]


def by_overlap(branches: int = 2) -> Decide:
    """Jumps to the best cards, ties by place."""

    def decide(asked: DataFrame) -> DataFrame:
        order = F.array_sort(F.transform("cards", lambda c: F.struct((-c["score"]).alias("s"), c["nth"].alias("nth"), c["id"].alias("id"))))
        return asked.select("query_id", "node_id", F.lit(JUMP).alias("action"), F.transform(F.slice(order, 1, branches), lambda c: c["id"]).alias("targets"))

    return decide


def by_reply(reply: Callable[[DataFrame], DataFrame], branches: int = 2) -> Decide:
    """By a model's replies: reply adds a column `reply` to what is asked."""
    from .navigator import decision

    def decide(asked: DataFrame) -> DataFrame:
        best = by_overlap(branches)(asked).select("query_id", "node_id", F.col("targets").alias("best"))
        read = reply(asked).join(best, ["query_id", "node_id"]).withColumn("d", decision(F.col("reply"), F.col("best")))
        return read.select("query_id", "node_id", "d.action", "d.targets")

    return decide


def walk(queries: DataFrame, nodes: DataFrame, cards: DataFrame, decide: Decide | None = None, branches: int = 2, shown: int = 8, clusters: int = 8, max_depth: int | None = None, budget: int = 800) -> DataFrame:
    """(query_id, node_id, place): the nodes where queries end, in the order of a depth-first walk, the first `clusters`."""
    decide = decide or by_overlap(branches)
    child = nodes.where(F.col("parent_id").isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy("parent_id").orderBy("node_id"))).where(F.col("nth") <= shown)
    held = within_budget(child.join(cards, "node_id"), ["parent_id"], ["nth"], "summary", budget)
    card = F.struct("nth", F.col("node_id").alias("id"), "label", "summary", "keywords", tokens(F.concat_ws(" ", "label", "summary", F.array_join("keywords", " "))).alias("words"))
    below = held.groupBy(F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(card)).alias("cards"))
    depth = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    depth = depth if max_depth is None else min(depth, max_depth)
    at = queries.select("query_id", "text", F.lit(ROOT).alias("node_id"), F.array().cast("array<int>").alias("way"))
    ended = None
    for level in range(depth):
        asked = at.join(below, "node_id", "left")
        over = asked.where(F.col("cards").isNull()).select("query_id", "node_id", "way")
        ended = over if ended is None else ended.unionByName(over)
        open_ = asked.where(F.col("cards").isNotNull())
        score = lambda c: F.round(overlap(tokens(F.col("text")), c["words"]), 9)
        seen = open_.withColumn("cards", F.transform("cards", lambda c: F.struct(c["nth"].alias("nth"), c["id"].alias("id"), c["label"].alias("label"), c["summary"].alias("summary"), c["keywords"].alias("keywords"), score(c).alias("score"))))
        seen = seen.withColumn("depth", F.lit(level))
        ids = F.transform("cards", lambda c: c["id"])
        chosen = seen.join(decide(seen.select("query_id", "text", "node_id", "depth", "cards")), ["query_id", "node_id"], "left").withColumn("targets", F.array_intersect(F.coalesce("targets", F.array().cast("array<string>")), ids))
        stop = F.coalesce(F.col("action") == RETRIEVE, F.lit(False))
        ended = ended.unionByName(chosen.where(stop).select("query_id", "node_id", "way"))
        going = chosen.where(~stop)
        best = by_overlap(branches)(going).select("query_id", "node_id", F.col("targets").alias("best"))
        going = going.join(best, ["query_id", "node_id"]).withColumn("targets", F.slice(F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.col("best")), 1, branches))
        at = going.select("query_id", "text", F.posexplode("targets").alias("i", "node_id"), "way").select("query_id", "text", "node_id", F.concat("way", F.array("i")).alias("way"))
    rest = at.select("query_id", "node_id", "way")
    ended = rest if ended is None else ended.unionByName(rest)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("way", "node_id"))
    return ended.withColumn("place", place).where(F.col("place") <= clusters).select("query_id", "node_id", "place")


def pool(queries: DataFrame, visited: DataFrame, members: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, from_tree, from_dense): documents below visited nodes, and those of near (query_id, doc_id)."""
    nowhere = queries.select("query_id").join(visited.select("query_id").distinct(), "query_id", "left_anti").withColumn("node_id", F.lit(ROOT))
    at = visited.select("query_id", "node_id").unionByName(nowhere).distinct()
    below = members.select("doc_id", F.explode(path_nodes(F.col("node_id"))).alias("node_id"))
    found = at.join(below, "node_id").select("query_id", "doc_id", F.lit(True).alias("from_tree"), F.lit(False).alias("from_dense"))
    if near is not None:
        found = found.unionByName(near.select("query_id", "doc_id", F.lit(False).alias("from_tree"), F.lit(True).alias("from_dense")))
    return found.groupBy("query_id", "doc_id").agg(F.max("from_tree").alias("from_tree"), F.max("from_dense").alias("from_dense"))


def rank(pooled: DataFrame, queries: DataFrame, index: Postings, limit: int, alpha: float = 0.0, asked: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The pool's first `limit`: by BM25, or for alpha > 0 by alpha * cosine + (1 - alpha) * z-score of BM25 within the pool.

    asked (query_id, embedding) and vectors (doc_id, embedding) are needed for alpha alone.
    """
    lexical = Bm25().scores(index, queries, pooled.select("query_id", "doc_id"))
    run = pooled.join(lexical, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if alpha > 0:
        mixed = D.blended(run.select("query_id", "doc_id", "score"), D.pair_scores(run, asked, vectors), alpha)
        run = run.drop("score").join(mixed, ["query_id", "doc_id"])
    return ranked(run, "query_id", "score", "doc_id", limit)


__all__ = ["JUMP", "RETRIEVE", "by_overlap", "by_reply", "pool", "rank", "walk"]
