"""What a navigator asks of an index: nodes' cards, documents of a subtree, prompts for a decision and its reply.

Documents are rows (doc_id, text) that may have title (string) and metadata (map of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..functions.vector import dot, normalised
from ..sources.layout import numbered, stored
from .lexical import Bm25, Postings, ranked
from .postings import build
from .tree import ROOT, path_nodes


def _title(docs: DataFrame) -> Column:
    return F.coalesce(F.col("title"), F.lit("")) if "title" in docs.columns else F.lit("")


def _metadata(docs: DataFrame) -> Column:
    """A document's metadata, with its doc_id unless they have one."""
    own = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"))
    if "metadata" not in docs.columns:
        return own
    held = F.coalesce(F.col("metadata"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.when(F.map_contains_key(held, "doc_id"), held).otherwise(F.map_concat(held, own))


def rag_documents(docs: DataFrame, doc_leaf: DataFrame, score: float = 1.0) -> DataFrame:
    """(doc_id, text, title, metadata, cluster_id, score); documents outside the tree have no cluster."""
    rows = docs.join(doc_leaf.select("doc_id", F.col("node_id").alias("cluster_id")), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _title(docs).alias("title"), _metadata(docs).alias("metadata"), "cluster_id", F.lit(float(score)).alias("score"))


def fetch(wanted: DataFrame, docs: DataFrame, doc_leaf: DataFrame) -> DataFrame:
    """rag_documents of the wanted (pos, doc_id) in their order; unknown ids are left out."""
    return wanted.join(rag_documents(docs, doc_leaf), "doc_id")


def cluster_info(node_id: str, cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (id, label, summary, keywords, depth); ValueError if the tree has no such node."""
    row = nodes.where(F.col("node_id") == node_id).join(cards, "node_id", "left").select(F.col("node_id").alias("id"), "label", "summary", "keywords", "depth")
    if row.isEmpty():
        raise ValueError(f"no node {node_id}")
    return row


def subtree(members: DataFrame, node_id: str | None) -> DataFrame:
    """Members of the leaves at or below a node; of all for None or the root."""
    if node_id is None or node_id == ROOT:
        return members
    return members.where((F.col("node_id") == node_id) | F.col("node_id").startswith(f"{node_id}."))


def search(queries: DataFrame, docs: DataFrame, members: DataFrame, node_id: str | None, limit: int = 20, index: Postings | None = None) -> DataFrame:
    """(query_id, doc_id, title, snippet, score, metadata, cluster_id, rank) of a node's documents by BM25 with the corpus's
    statistics, from the index (built of docs without one); only the node's documents are scored.

    If no score of a query is positive, all the node's documents are ranked, those without a shared term at 0.  Of these only
    the first by id can be shown, so a query meets as many of them, by number, as it may need.
    """
    inside = subtree(members, node_id).select("doc_id", F.col("node_id").alias("cluster_id"))
    index, within = index or build(docs), inside.select("doc_id") if node_id not in (None, ROOT) else None
    good = ranked(Bm25().first(index, queries, limit, within).where("score > 0"), "query_id", "score", "doc_id", limit).select("query_id", "doc_id", "score")
    good = stored(good)
    dull = queries.select("query_id").join(good.select("query_id").distinct(), "query_id", "left_anti")
    low = stored(Bm25().scores(index, queries.join(dull, "query_id", "left_semi"), within).select("query_id", "doc_id", "score"))
    most = dull.join(low.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("n", F.lit(0)) + limit - 1)).alias("number"))
    fill = most.join(numbered(inside.select("doc_id").distinct(), "doc_id", "number"), "number").select("query_id", "doc_id")
    fill = fill.join(low.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    rows = ranked(good.unionByName(low).unionByName(fill), "query_id", "score", "doc_id", limit)
    shown = docs.select("doc_id", F.when(_title(docs) == "", "Untitled").otherwise(_title(docs)).alias("title"), snippet(F.col("text")).alias("snippet"), _metadata(docs).alias("metadata"))
    return rows.join(shown, "doc_id").join(inside, "doc_id")


def peek(docs: DataFrame, members: DataFrame, limit: int = 10) -> DataFrame:
    """(node_id, doc_id, title, snippet, rank): the first documents of every leaf, as an empty query ranks them."""
    first = members.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy("doc_id"))).where(F.col("rank") <= limit)
    return first.join(docs.select("doc_id", F.when(_title(docs) == "", "Untitled").otherwise(_title(docs)).alias("title"), snippet(F.col("text")).alias("snippet")), "doc_id")


def representatives(members: DataFrame, vectors: DataFrame, centroids: DataFrame, size: int = 5) -> DataFrame:
    """(node_id, doc_id, place): a node's members that are most similar to its centroid; all by id where there are few."""
    rows = members.select("doc_id", F.explode(path_nodes(F.col("node_id"))).alias("node_id"))
    counts = rows.groupBy("node_id").agg(F.count("*").alias("n"))
    rows = rows.join(vectors.select("doc_id", normalised(F.col("embedding")).alias("v")), "doc_id")
    rows = rows.join(centroids.select("node_id", normalised(F.col("centroid")).alias("c")).join(counts, "node_id"), "node_id")
    near = F.when(F.col("n") <= size, F.lit(0.0)).otherwise(dot(F.col("v"), F.col("c")))
    return ranked(rows.select("node_id", "doc_id", near.alias("score")), "node_id", "score", "doc_id", size).select("node_id", "doc_id", F.col("rank").alias("place"))


def targets_in_order(targets: DataFrame, queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, node_id, place): targets by the similarity of their centroids to the query."""
    rows = targets.join(queries.select("query_id", normalised(F.col("embedding")).alias("q")), "query_id").join(centroids.select("node_id", normalised(F.col("centroid")).alias("c")), "node_id")
    return ranked(rows.select("query_id", "node_id", dot(F.col("q"), F.col("c")).alias("score")), "query_id", "score", "node_id").select("query_id", "node_id", F.col("rank").alias("place"))


def prompts(queries: DataFrame, cards: DataFrame, node_id: str, depth: int, max_depth: int) -> DataFrame:
    """(query_id, message): a node's cards (id, label, summary, keywords, n_docs, in order of id) as a question; a node has
    few children, so their text is one value that all queries share."""
    line = F.concat(
        F.lit("  ID: "), "id", F.lit("\n  Label: "), F.coalesce("label", F.lit("?")), F.lit("\n  Summary: "), F.coalesce(F.substring("summary", 1, 200), F.lit("")),
        F.lit("\n  Keywords: "), F.array_join(F.slice("keywords", 1, 6), ", "), F.lit("\n  Docs: "), F.col("n_docs").cast("string"), F.lit("\n"),
    )
    held = cards.select(F.struct("id", line.alias("line")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("cards"))
    head = F.concat(F.lit("Query: "), "text", F.lit(f"\nCurrent cluster: {'ROOT' if node_id == ROOT else node_id}\nDepth: {depth} / {max_depth}\nClusters collected so far: exploring...\n\nChild clusters to choose from:\n"))
    return queries.join(F.broadcast(held)).select("query_id", F.concat(head, "cards").alias("message"))


def decision(reply: Column, fallback: Column) -> Column:
    """(action, targets) of a model's reply: its first object, code fences aside; RETRIEVE, or a JUMP to its targets, or to the
    first two of fallback if the reply has none or can't be read."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(reply, F.lit("")), r"```(?:json)?", ""), r"^[\s`]+|[\s`]+$", "")
    found = F.from_json(F.regexp_extract(bare, r"(?s)(\{.*?\})", 1), "action string, targets array<string>")
    action = F.upper(F.coalesce(found["action"], F.lit("JUMP")))
    targets = F.when(F.size(found["targets"]) > 0, found["targets"]).otherwise(F.slice(fallback, 1, 2))
    none = F.array().cast("array<string>")
    return F.when(action == "RETRIEVE", F.struct(F.lit("RETRIEVE").alias("action"), none.alias("targets"))).otherwise(F.struct(F.lit("JUMP").alias("action"), F.coalesce(targets, none).alias("targets")))


def page(rows: DataFrame, order: str, offset: int, limit: int | None = None) -> DataFrame:
    """Rows from offset on, limit of them."""
    rest = rows.orderBy(order).offset(offset)
    return rest if limit is None else rest.limit(limit)
