"""Building a tree by k-means, level by level: each level is a handful of jobs over all documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, mean_vector, normalised
from ..sources.layout import stored as _stored
from .tree import ROOT


@dataclass(frozen=True)
class BuildConfig:
    branching: int = 8
    max_depth: int = 4
    min_leaf: int = 25
    max_leaf: int = 250
    iterations: int = 20
    seed: int = 42


def build(vectors: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(doc_id, node_id) leaf memberships of vectors (doc_id, embedding); the root alone if nothing can be split.

    A node splits if it is above max_depth and has more than max_leaf documents, into
    max(2, min(branching, ceil(n / max_leaf), n)) clusters; if a cluster has less than min_leaf, the node stays a leaf.
    """
    rows = _stored(vectors.select("doc_id", normalised(F.col("embedding")).alias("v"), F.lit(ROOT).alias("node_id"), F.lit(False).alias("closed")))
    for level in range(config.max_depth):
        sizes = rows.where("not closed").groupBy("node_id").agg(F.count("*").alias("n")).where(F.col("n") > config.max_leaf)
        k = F.greatest(F.lit(2), F.least(F.lit(config.branching), F.ceil(F.col("n") / config.max_leaf), F.col("n"))).cast("int")
        sizes = _stored(sizes.select("node_id", k.alias("k")))
        if sizes.isEmpty():
            break
        open_ = rows.where("not closed").join(sizes, "node_id")
        # the first k documents by a seeded hash: min_by keeps a bounded list a task, not a sorted node
        dealt = open_.select("node_id", "k", "v", F.pmod(F.xxhash64(F.lit(config.seed), "doc_id"), F.col("k")).alias("c"), F.xxhash64(F.lit(config.seed + 1), "doc_id").alias("h"))
        centers = dealt.groupBy("node_id", "c").agg(F.min_by("v", "h").alias("center"))
        for step in range(config.iterations + 1):
            listed = centers.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("c", "center"))).alias("centers"))
            near = F.transform("centers", lambda x: F.struct(F.round(dot(x["center"], F.col("v")), 9).alias("s"), (-x["c"]).alias("c")))
            assigned = open_.join(_stored(listed), "node_id").select("doc_id", "node_id", "v", (-F.array_max(near)["c"]).alias("c"))
            if step < config.iterations:
                means = mean_vector(assigned, ["node_id", "c"], "v", "center")
                centers = means.select("node_id", "c", normalised(F.col("center")).alias("center"))
        assigned = _stored(assigned)
        parts = assigned.groupBy("node_id", "c").agg(F.count("*").alias("n"))
        good = parts.groupBy("node_id").agg(F.count("*").alias("parts"), F.min("n").alias("least")).where((F.col("parts") > 1) & (F.col("least") >= config.min_leaf)).select("node_id", F.lit(True).alias("split"))
        # clusters that have documents are numbered without gaps
        occurring = parts.groupBy("node_id").agg(F.array_sort(F.collect_list("c")).alias("numbers"))
        numbered = assigned.join(occurring, "node_id").withColumn("c", (F.array_position("numbers", F.col("c")) - 1).cast("int"))
        moved = numbered.join(good, "node_id", "left").select("doc_id", F.col("node_id").alias("_from"), "split", "c")
        child = F.when(F.col("node_id") == ROOT, F.concat(F.lit("c"), F.col("c"))).otherwise(F.concat_ws(".", "node_id", F.col("c").cast("string")))
        rows = _stored(
            rows.join(moved, "doc_id", "left").select(
                "doc_id", "v", F.when(F.col("split"), child).otherwise(F.col("node_id")).alias("node_id"), (~F.coalesce("split", F.lit(False))).alias("closed")
            )
        )
    return rows.select("doc_id", "node_id")


def checked(docs: DataFrame, vectors: DataFrame) -> None:
    """ValueError unless there are documents, their ids differ, and each has one vector, all of one length."""
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if not n:
        raise ValueError("there are no documents to build a hierarchy of")
    if ids != n:
        raise ValueError("document ids recur or are null")
    lengths = docs.select("doc_id").join(vectors.select("doc_id", F.size("embedding").alias("size")), "doc_id").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).first()
    if lengths["n"] != n:
        raise ValueError(f"{n} documents have {lengths['n']} vectors")
    if lengths["least"] != lengths["most"] or lengths["least"] < 1:
        raise ValueError(f"vectors have {lengths['least']} to {lengths['most']} numbers")


def index(docs: DataFrame, encoder=None, vectors: DataFrame | None = None, config: BuildConfig = BuildConfig(), words: int = 8) -> dict[str, DataFrame]:
    """A hierarchy as one product: documents, embeddings (by the encoder if no vectors are given), nodes with parent, depth, size,
    label, summary, keywords and unit centroid, and members of the nodes of every level."""
    from ..sources.encoders import passage
    from .navigate import cards
    from .tree import nodes_of, path_nodes, subtree_counts

    if vectors is None:
        if docs.isEmpty():
            raise ValueError("there are no documents to build a hierarchy of")
        vectors = encoder.encode(docs, "doc_id", passage(docs))[0]
    vectors = _stored(vectors.select("doc_id", "embedding"))
    checked(docs, vectors)
    leaves = _stored(build(vectors, config))
    members = _stored(leaves.select(F.explode(path_nodes(F.col("node_id"))).alias("node_id"), "doc_id"))
    middle = mean_vector(members.join(vectors.select("doc_id", normalised(F.col("embedding")).alias("v")), "doc_id"), ["node_id"], "v").select("node_id", normalised(F.col("centroid")).alias("centroid"))
    named = cards(docs.select("doc_id", F.col("text")), leaves, words)
    nodes = nodes_of(leaves).join(subtree_counts(leaves), "node_id").join(named, "node_id", "left").join(middle, "node_id")
    return {"documents": docs, "embeddings": vectors, "nodes": _stored(nodes), "members": members}
