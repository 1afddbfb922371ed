"""Trajectories and registries: replay selection, distillation, trace compaction, versions and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def successful(rows: DataFrame, least: float, limit: int, score: str = "score", created: str = "created_at", tie: str = "trajectory_id") -> DataFrame:
    """The best trajectories: by score and age, both descending; a top-k, which Spark takes in one pass."""
    return rows.where(F.col(score) >= least).orderBy(F.col(score).desc(), F.col(created).desc(), F.col(tie)).limit(limit)


def ordered_distinct(rows: DataFrame, by: str, value: str, order: list[str], out: str) -> DataFrame:
    """For each group its distinct values by first occurrence; counted down to one row a value before they are listed."""
    first = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(out))


def compact(trace: DataFrame, by: str, order: str, text: str, events: int = 12, size: int = 800) -> DataFrame:
    """The first events of each trace, their texts cut to size."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return trace.withColumn("_n", place).where(F.col("_n") <= events).drop("_n").withColumn(text, F.substring(F.coalesce(text, F.lit("")), 1, size))


#: What a compacted event keeps by its name (fixed values); others keep OTHER_FIELDS.
FIELDS = {
    "generated_code": ("event", "depth", "step", "cluster_id", "code"),
    "search_in_cluster": ("event", "depth", "cluster_id", "query", "num_results", "top_results"),
    "search_documents": ("event", "depth", "cluster_id", "query", "num_results", "top_results"),
    "ground_query": ("event", "depth", "cluster_id", "query", "num_results", "top_results"),
    "rank_clusters_llm": ("event", "depth", "query", "ranked"),
    "sandbox_result": ("event", "depth", "step", "success", "error", "done"),
}
OTHER_FIELDS = ("event", "depth", "query", "cluster_id", "sub_query", "num_final_doc_ids", "docs_spent", "inspects_spent")


def compact_event(event: Column, columns: list[str]) -> Column:
    """A struct event with the fields that its name doesn't keep set to null, code cut to 800, results and ranks to 3."""
    name = event["event"]
    known = [n for n in FIELDS]
    out = []
    for c in columns:
        keeps = name.isin(*[n for n in known if c in FIELDS[n]]) if any(c in f for f in FIELDS.values()) else F.lit(False)
        keeps = keeps | (~name.isin(*known) & F.lit(c in OTHER_FIELDS))
        value = event[c]
        value = F.substring(value, 1, 800) if c == "code" else F.slice(value, 1, 3) if c in ("top_results", "ranked") else value
        out.append(F.when(keeps, value).alias(c))
    return F.struct(*out)


def add_version(registry: DataFrame, version: DataFrame, promote: bool) -> DataFrame:
    """registry (version, created_at, promoted, ...) with the one-row version in place of a like-named one; if it is
    promoted, the others aren't any more."""
    kept = registry.join(version.select("version"), "version", "left_anti")
    if promote:
        kept = kept.withColumn("promoted", F.lit(False))
    return kept.unionByName(version.withColumn("promoted", F.lit(promote)), allowMissingColumns=True)


def current(registry: DataFrame, by: str) -> DataFrame:
    """The latest promoted version of each group."""
    return registry.where("promoted").groupBy(by).agg(F.max(F.struct("created_at", "version")).alias("_v")).select(by, F.col("_v.version").alias("version"))


def should_promote(candidate: Column, baseline: Column, delta: float = 0.0) -> Column:
    """At least delta better; without a baseline, a candidate's metric is enough."""
    return F.coalesce(candidate >= baseline + delta, candidate.isNotNull() & baseline.isNull())
