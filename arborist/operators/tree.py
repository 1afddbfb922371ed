"""Trees as edge tables: nodes (node_id, parent_id, depth), members (node_id, doc_id) of leaves.

Node ids are paths (root; then a, a.b ...), so a closure is a column expression and not a recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "root"


def path_nodes(node: Column) -> Column:
    """A node's ancestors from the root to itself."""
    parts = F.split(node, r"\.")
    down = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.when(node == ROOT, F.array(F.lit(ROOT))).otherwise(F.concat(F.array(F.lit(ROOT)), down))


def parent(node: Column) -> Column:
    up = F.regexp_replace(node, r"\.[^.]*$", "")
    return F.when(node != ROOT, F.when(up == node, F.lit(ROOT)).otherwise(up))


def nodes_of(leaves: DataFrame) -> DataFrame:
    """(node_id, parent_id, depth) of all nodes above and at the leaves' node_id."""
    rows = leaves.select("node_id").distinct().select(F.posexplode(path_nodes(F.col("node_id"))).alias("depth", "node_id")).distinct()
    return rows.select("node_id", parent(F.col("node_id")).alias("parent_id"), F.col("depth").cast("bigint").alias("depth"))


def closure(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, distance), each node its own ancestor at distance 0."""
    rows = nodes.select("node_id", F.posexplode(F.reverse(path_nodes(F.col("node_id")))).alias("distance", "ancestor_id"))
    return rows.select("node_id", "ancestor_id", F.col("distance").cast("bigint").alias("distance"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")


def lowest_common_ancestor(a: Column, b: Column) -> Column:
    shared = F.array_intersect(path_nodes(a), path_nodes(b))
    return F.element_at(shared, -1)


def descent(ancestor: Column, node: Column) -> Column:
    """The path from ancestor down to node; null if it isn't one."""
    path = path_nodes(node)
    at = F.array_position(path, ancestor).cast("int")
    return F.when(at > 0, F.slice(path, at, F.size(path)))


def subtree_counts(members: DataFrame) -> DataFrame:
    """(node_id, n_docs): members of all leaves below; counted by leaf before ancestors are made."""
    by_leaf = members.groupBy("node_id").agg(F.count("*").alias("n"))
    rows = by_leaf.select(F.explode(path_nodes(F.col("node_id"))).alias("node_id"), "n")
    return rows.groupBy("node_id").agg(F.sum("n").alias("n_docs"))


def children(nodes: DataFrame, node_id: str, levels: int) -> DataFrame:
    """Nodes up to levels below node_id, in pre-order."""
    below = closure(nodes).where((F.col("ancestor_id") == node_id) & F.col("distance").between(1, levels))
    return below.select("node_id", "distance").orderBy("node_id")


def target_nodes(relevant: DataFrame, doc_leaf: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """(query_id, node_id): leaves of relevant documents, raised to the highest ancestor whose subtree has at most
    threshold documents if a query has several leaves.  Subtrees only grow upwards, so that is one maximum."""
    found = relevant.join(doc_leaf, "doc_id").select("query_id", "node_id").distinct()
    several = F.count("*").over(Window.partitionBy("query_id")) > 1
    rows = found.withColumn("several", several).withColumn("path", path_nodes(F.col("node_id")))
    up = rows.select("query_id", F.col("node_id").alias("leaf"), "several", F.posexplode("path").alias("depth", "node_id")).join(counts, "node_id")
    fits = (F.col("node_id") == F.col("leaf")) | (F.col("several") & (F.col("n_docs") <= threshold))
    return up.where(fits).groupBy("query_id", "leaf").agg(F.min_by("node_id", "depth").alias("node_id")).select("query_id", "node_id").distinct()


def text(nodes: DataFrame, name: str) -> DataFrame:
    """One row (hierarchy): the nodes in pre-order, two blanks a level; node tables are small beside their corpus."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), "node_id", F.lit(": "), F.coalesce(F.substring(name, 1, 200), F.lit("")))
    # the root's path is empty, so it comes first; an id comes before what starts with it and a dot
    order = F.when(F.col("node_id") == ROOT, F.array().cast("array<string>")).otherwise(F.split("node_id", r"\."))
    return nodes.select(F.struct(order.alias("path"), line.alias("line")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("hierarchy"))


def greedy_walk(queries: DataFrame, nodes: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, node_id): from the root to the child of the most similar centroid until a leaf.

    Edges are scored once for all queries; then the walk is a path of best edges, joined level by level (as many joins as
    the tree has levels).
    """
    from ..functions.vector import dot, normalised

    asked = queries.select("query_id", normalised(F.col("embedding")).alias("_q"))
    ends = nodes.where(F.col("parent_id").isNotNull()).join(centroids.select("node_id", normalised(F.col("centroid")).alias("_c")), "node_id")
    depth = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    at = asked.withColumn("node_id", F.lit(ROOT))
    for _ in range(depth):
        step = at.join(ends.select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), "_c"), "node_id", "left")
        step = step.withColumn("s", F.round(dot(F.col("_q"), F.col("_c")), 9))
        best = step.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc_nulls_last(), "child"))).where("r = 1")
        at = best.select("query_id", "_q", F.coalesce("child", "node_id").alias("node_id"))
    return at.select("query_id", "node_id")
