"""Supervision records of a navigation policy: oracle trajectories with their states, candidates and off-path recoveries.

A trajectory visits a query's targets one after another; its rows come from paths (see supervision.route) by windows over
the trajectory's own steps, which are as few as its targets are.  A record holds the state before a step (node, path,
evidence, calls, budgets), the action, whether enough evidence was gathered, and for a jump its candidates: the positive
first, then the query's nearest nodes, children, parent, siblings and nodes by chance, up to k_max, padded.  From each jump
some wrong moves are made, and the record there says how to get back: up, if the parent lies on the way, else by a jump.

Candidates are gathered by joins on the node or the query, and limited by place within a record; nodes by chance are drawn
by number, so no record meets all nodes.

Cases: queries without a target in the tree have no records; relevant documents outside the tree don't count; a query
without relevant documents is never done; ties in similarity go by node; children and siblings come by id, evidence that is found
in one step by document id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layout import numbered, stored
from .supervision import AGGREGATE, JUMP, RETRIEVE, route
from .tree import ROOT, lowest_common_ancestor, parent, path_nodes

SOURCES = ("positive", "ann", "child", "parent", "sibling", "random")
KEY = ("trajectory_id", "step", "repeat")


@dataclass(frozen=True)
class RecordConfig:
    nearest: int = 24
    k_max: int = 32
    off_path: int = 2
    tau_done: float = 1.0
    random: int = 6
    repeats: int = 1
    max_docs: int = 100
    max_calls: int = 16
    trajectories: int = 1
    seed: int = 42


def orders(targets: DataFrame, config: RecordConfig) -> DataFrame:
    """(query_id, trajectory_id, node_id, leg) of targets (query_id, node_id, place): the first trajectory by place, further
    ones by a seeded hash."""
    rows = targets.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(config.trajectories - 1))))
    drawn = F.md5(F.concat_ws(":", F.lit(str(config.seed)), F.col("_t").cast("string"), F.col("query_id").cast("string"), "node_id"))
    order = Window.partitionBy("query_id", "_t").orderBy(F.when(F.col("_t") == 0, F.col("place")), F.when(F.col("_t") > 0, drawn), "node_id")
    name = F.concat_ws(":", F.col("query_id").cast("string"), F.col("_t").cast("string"))
    return rows.select("query_id", name.alias("trajectory_id"), "node_id", F.row_number().over(order).alias("leg"))


def steps(ordered: DataFrame) -> DataFrame:
    """All steps of orders(), with the state's node, path and calls; the last row of a trajectory is its end."""
    by_leg = Window.partitionBy("trajectory_id").orderBy("leg")
    rest = Window.partitionBy("trajectory_id").orderBy("leg").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("trajectory_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    legs = ordered.withColumn("here", F.coalesce(F.lag("node_id").over(by_leg), F.lit(ROOT))).withColumn("last", F.lead("leg").over(by_leg).isNull())
    legs = legs.withColumn("ahead", F.array_distinct(F.flatten(F.collect_list(path_nodes(F.col("node_id"))).over(rest)))).withColumn("targets", F.collect_list("node_id").over(every))
    way = route(F.col("here"), F.col("node_id"))
    end = F.array(F.struct(F.lit("END").alias("action"), F.col("node_id").alias("node")))
    rows = legs.select("query_id", "trajectory_id", "leg", F.col("node_id").alias("target"), "ahead", "targets", F.posexplode(F.when(F.col("last"), F.concat(way, end)).otherwise(way)).alias("at", "x"))
    order = Window.partitionBy("trajectory_id").orderBy("leg", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    went = F.collect_list(F.when(F.col("x.action") != RETRIEVE, F.col("x.node"))).over(before)
    calls = [F.coalesce(F.sum((F.col("x.action") == a).cast("int")).over(before), F.lit(0)).cast("int").alias(n) for a, n in ((RETRIEVE, "retrieves"), (JUMP, "jumps"), (AGGREGATE, "aggregates"))]
    node = F.coalesce(F.lag("x.node").over(order), F.lit(ROOT))
    rows = rows.select("query_id", "trajectory_id", (F.row_number().over(order) - 1).cast("int").alias("step"), node.alias("node_id"), F.concat(F.array(F.lit(ROOT)), went).alias("path"), *calls, F.col("x.action").alias("move"), F.col("x.node").alias("next"), "target", "ahead", "targets")
    ends = F.col("move") == "END"
    action = F.when(~ends, F.col("move")).when(F.col("node_id") == ROOT, JUMP).otherwise(AGGREGATE)
    return rows.withColumn("action", action).withColumn("terminal", ends).withColumn("target", F.when(~ends, F.col("target"))).withColumn("ahead", F.when(~ends, F.col("ahead")).otherwise(F.array().cast("array<string>"))).withColumn("gold", F.when(F.col("move") == JUMP, F.col("next"))).drop("move")


def with_evidence(rows: DataFrame, members: DataFrame, relevant: DataFrame, config: RecordConfig) -> DataFrame:
    """rows of steps() with evidence (relevant documents of nodes retrieved before), relevant, and done."""
    known = relevant.select("query_id", "doc_id").distinct().join(members.select("doc_id", F.col("node_id").alias("leaf")), "doc_id")
    wanted = known.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("relevant"))
    taken = rows.where((F.col("action") == RETRIEVE)).select("query_id", "trajectory_id", "step", F.col("node_id").alias("above"))
    under = known.select("query_id", "doc_id", F.explode(path_nodes(F.col("leaf"))).alias("above"))
    first = taken.join(under, ["query_id", "above"]).groupBy("trajectory_id", "doc_id").agg(F.min("step").alias("at"))
    found = first.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id"))).alias("found"))
    out = rows.join(found, "trajectory_id", "left").join(wanted, "query_id", "left")
    none = F.array().cast(members.schema["doc_id"].dataType.simpleString().join(("array<", ">")))
    have = F.transform(F.filter(F.coalesce("found", F.array().cast(out.schema["found"].dataType)), lambda x: x["at"] < F.col("step")), lambda x: x["doc_id"])
    out = out.withColumn("evidence", have).withColumn("relevant", F.coalesce("relevant", none)).drop("found")
    recall = F.size(F.array_intersect("evidence", "relevant")) / F.size("relevant")
    return out.withColumn("done", (F.size("relevant") > 0) & (recall + 1e-9 >= config.tau_done))


def off_path(rows: DataFrame, nodes: DataFrame, nearest: DataFrame, config: RecordConfig) -> DataFrame:
    """Records a wrong move away from each jump of rows: siblings of where it goes, then the query's nearest nodes, none of them
    on the way to the target."""
    jumps = rows.where(F.col("gold").isNotNull()).withColumn("way", path_nodes(F.col("target")))
    edges = nodes.where(F.col("parent_id").isNotNull()).select("parent_id", F.col("node_id").alias("m"))
    beside = jumps.withColumn("parent_id", parent(F.col("gold"))).join(edges, "parent_id").select("trajectory_id", "step", "m", F.lit(1).alias("s"), F.lit(0).alias("r"), "node_id", "way", "gold")
    near = jumps.join(nearest.where(F.col("rank") <= config.nearest).select("query_id", F.col("node_id").alias("m"), F.col("rank").alias("r")), "query_id").select("trajectory_id", "step", "m", F.lit(2).alias("s"), F.col("r").cast("int").alias("r"), "node_id", "way", "gold")
    pool = beside.unionByName(near).where((F.col("m") != F.col("node_id")) & (F.col("m") != F.col("gold")) & ~F.array_contains("way", F.col("m")))
    pool = pool.groupBy("trajectory_id", "step", "m").agg(F.min(F.struct("s", "r")).alias("o"))
    place = F.row_number().over(Window.partitionBy("trajectory_id", "step").orderBy("o", "m"))
    picks = pool.withColumn("i", place - 1).where(F.col("i") < config.off_path).select("trajectory_id", "step", "m", "i")
    out = jumps.join(picks, ["trajectory_id", "step"])
    shared = F.size(path_nodes(lowest_common_ancestor(F.col("m"), F.col("target"))))
    up = (F.size(path_nodes(F.col("m"))) - shared == 1) & F.array_contains("way", parent(F.col("m")))
    back = F.coalesce(F.get("way", shared), F.col("target"))
    name = F.concat("trajectory_id", F.lit(".off"), F.col("step").cast("string"), F.lit("_"), F.col("i").cast("string"))
    return out.select(
        "query_id", name.alias("trajectory_id"), (F.col("step") + 1).alias("step"), F.col("m").alias("node_id"), F.concat("path", F.array("m")).alias("path"), "retrieves", (F.col("jumps") + 1).alias("jumps"), "aggregates",
        F.when(up, parent(F.col("m"))).otherwise(back).alias("next"), "target", F.col("way").alias("ahead"), "targets", F.when(up, AGGREGATE).otherwise(JUMP).alias("action"), F.lit(False).alias("terminal"), F.when(~up, back).alias("gold"), "evidence", "relevant", "done",
    )


def candidates(rows: DataFrame, nodes: DataFrame, nearest: DataFrame, config: RecordConfig) -> DataFrame:
    """trajectory_id, step, and candidates, sources, mask and positives (places from 0) of the jumps among rows."""
    jumps = rows.where(F.col("action") == JUMP).select("query_id", "trajectory_id", "step", "node_id", "gold", "ahead", parent(F.col("node_id")).alias("up"))
    key = ["trajectory_id", "step"]
    edges = nodes.where(F.col("parent_id").isNotNull()).select("parent_id", F.col("node_id").alias("c"))

    def kind(found, s, r=F.lit(0)):
        return found.select(*key, "c", F.lit(s).alias("s"), r.cast("int").alias("r"))

    parts = [
        kind(jumps.where(F.col("gold").isNotNull()).withColumn("c", F.col("gold")), 0),
        kind(jumps.join(nearest.where(F.col("rank") <= config.nearest).select("query_id", F.col("node_id").alias("c"), "rank"), "query_id"), 1, F.col("rank")),
        kind(jumps.join(edges, F.col("node_id") == F.col("parent_id")), 2),
        kind(jumps.where(F.col("up").isNotNull()).withColumn("c", F.col("up")), 3),
        kind(jumps.join(edges, F.col("up") == F.col("parent_id")).where(F.col("c") != F.col("node_id")), 4),
    ]
    if config.random:
        every = stored(numbered(nodes.select(F.col("node_id").alias("c")), "c", "number"))
        n = every.count()
        draw = F.pmod(F.xxhash64(F.lit(config.seed), *key, "i"), F.lit(n))
        drawn = jumps.select(*key, F.explode(F.sequence(F.lit(1), F.lit(config.random))).alias("i")).withColumn("number", draw)
        parts.append(kind(drawn.join(every, "number"), 5, F.col("i")))
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    pool = pool.groupBy(*key, "c").agg(F.min(F.struct("s", "r")).alias("o"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("o", "c"))
    pool = pool.withColumn("place", place - 1).where(F.col("place") < config.k_max)
    pool = pool.join(jumps.select(*key, "node_id", "gold", "ahead"), key)
    onward = F.array_contains("ahead", F.col("c")) & (F.col("c") != F.col("node_id")) & F.array_contains(path_nodes(F.col("c")), F.col("node_id"))
    pool = pool.withColumn("p", F.coalesce(F.col("c") == F.col("gold"), F.lit(False)) | onward)
    held = pool.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "c", F.col("o.s").alias("s"), "p"))).alias("x"), F.first("gold", True).alias("gold"))
    names = F.array(*(F.lit(s) for s in SOURCES))
    padding = lambda v: F.array_repeat(F.lit(v), config.k_max - F.size("x"))
    sources = F.transform("x", lambda x: F.get(names, x["s"]))
    positives = F.transform(F.filter("x", lambda x: x["p"]), lambda x: x["place"])
    first_near = F.array_position(sources, "ann").cast("int") - 1
    positives = F.when((F.size(positives) == 0) & F.col("gold").isNull() & (first_near >= 0), F.array(first_near)).otherwise(positives)
    return held.select(*key, F.concat(F.transform("x", lambda x: x["c"]), padding("")).alias("candidates"), F.concat(sources, padding("padding")).alias("sources"), F.concat(F.transform("x", lambda _: F.lit(1)), padding(0)).alias("mask"), positives.alias("positives"))


def records(targets: DataFrame, members: DataFrame, relevant: DataFrame, nodes: DataFrame, nearest: DataFrame, config: RecordConfig = RecordConfig()) -> DataFrame:
    """All records of targets (query_id, node_id, place), by nearest (query_id, node_id, rank): on and off the path."""
    on = stored(with_evidence(steps(orders(targets, config)), members, relevant, config))
    rows = on.withColumn("is_off_path", F.lit(False))
    if config.off_path:
        rows = stored(rows.unionByName(off_path(on, nodes, nearest, config).withColumn("is_off_path", F.lit(True))))
    rows = rows.join(candidates(rows, nodes, nearest, config), ["trajectory_id", "step"], "left")
    repeats = F.when((F.col("action") == RETRIEVE) & ~F.col("is_off_path"), config.repeats).otherwise(1)
    calls = F.col("retrieves") + F.col("jumps") + F.col("aggregates")
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), repeats - 1)))
    return rows.withColumn("docs_left", F.greatest(F.lit(config.max_docs) - F.size("evidence"), F.lit(0))).withColumn("calls_left", F.greatest(F.lit(config.max_calls) - calls, F.lit(0)))


#: The invariants of a record, each with what breaks it.
def _invariants(tau_done: float) -> dict[str, Column]:
    jump, size = F.col("action") == JUMP, F.size("candidates")
    masked = F.exists("positives", lambda i: F.coalesce(F.get("mask", i), F.lit(0)) == 0)
    recall = F.size(F.array_intersect("evidence", "relevant")) / F.size("relevant")
    return {
        "path starts at the root": (F.size("path") > 0) & (F.get("path", F.lit(0)) != ROOT),
        "path ends at the node": (F.size("path") > 0) & (F.element_at("path", -1) != F.col("node_id")),
        "no aggregation at the root": (F.col("action") == AGGREGATE) & (F.col("node_id") == ROOT),
        "a jump has positives": jump & (F.coalesce(F.size("positives"), F.lit(-1)) <= 0),
        "positives are real candidates": jump & F.exists("positives", lambda i: (i < 0) | (i >= size)) | jump & masked,
        "retrieval at a target": (F.col("action") == RETRIEVE) & ~F.array_contains("targets", F.col("node_id")),
        "done has the evidence": F.col("done") & (F.size("relevant") > 0) & (recall + 1e-9 < tau_done),
    }


def violations(rows: DataFrame, tau_done: float = 1.0) -> DataFrame:
    """rows with `broken`, the invariants that they break; only such rows."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in _invariants(tau_done).items())))
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)


def sink(rows: DataFrame, folder: str) -> DataFrame:
    """Appends records as JSON lines if none breaks an invariant; gives rows, jumps, off-path and done records by action."""
    rows = stored(rows)
    bad = violations(rows).select(*KEY, "broken").limit(5).collect()
    if bad:
        raise ValueError(f"records break invariants: {bad}")
    rows.write.mode("append").json(folder)
    return summary(rows)


def summary(rows: DataFrame) -> DataFrame:
    """(action, n, off_path, done) of records."""
    return rows.groupBy("action").agg(F.count("*").alias("n"), F.sum(F.col("is_off_path").cast("bigint")).alias("off_path"), F.sum(F.col("done").cast("bigint")).alias("done"))


__all__ = ["RecordConfig", "candidates", "off_path", "orders", "records", "sink", "steps", "summary", "violations", "with_evidence"]
