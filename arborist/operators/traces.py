"""Traces of tool calls as supervision rows, and their distillation.

An event is a row (trajectory_id, seq, event, cluster_id, docs, reward): `enter` a node, `recurse` to one, `search_in_cluster`
with the documents it showed, and `return` with its final documents.  Events that name no node of the tree are passed over, and
so are searches without documents.  A recursion is a jump from the last node that was named before it, a search a retrieval
at its node; evidence is what searches and returns gave before.  Trajectories of a reward below the least have no rows; others
that have rows end with one more retrieval, which is done.

`convert` does this by windows over a trajectory; `fold` does the same event by event, and is the state of `convert_stream`,
which gives a trajectory's rows when its last event (`end`) arrives, or at the watermark.  Both give the same rows.

Cases: ties in seq go by event, node, then documents; a null reward is below any; repeated events count as often as they are there in both
forms; a trajectory without a named node stands at the root.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tree import ROOT, path_nodes

ENTER, RECURSE, SEARCH, RETURN, END = "enter", "recurse", "search_in_cluster", "return", "end"
ROWS = "trajectory_id string, step int, node_id string, action string, target string, evidence array<bigint>, retrieves int, jumps int, done boolean"


def known(events: DataFrame, nodes: DataFrame, least_reward: float) -> DataFrame:
    """Events that count: of rewarded trajectories, at nodes of the tree; also of a stream, as nodes are a table."""
    rows = events.where(F.coalesce(F.col("reward") >= least_reward, F.lit(False)))
    rows = rows.join(nodes.select(F.col("node_id").alias("cluster_id"), F.lit(True).alias("_there")), "cluster_id", "left")
    there = F.col("_there") & (F.col("event").isin(ENTER, RECURSE) | (F.col("event") == SEARCH) & (F.size("docs") > 0))
    return rows.where(F.coalesce(there, F.lit(False)) | F.col("event").isin(RETURN, END)).select(F.col("trajectory_id").cast("string").alias("trajectory_id"), "seq", "event", "cluster_id", F.coalesce("docs", F.array().cast("array<bigint>")).alias("docs"), *[c for c in ("at",) if c in events.columns])


def convert(events: DataFrame) -> DataFrame:
    """ROWS of known() events, with the path of each row's node."""
    order = Window.partitionBy("trajectory_id").orderBy("seq", "event", "cluster_id", "docs")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col("event").isin(ENTER, RECURSE, SEARCH), F.col("cluster_id"))
    gave = F.when(F.col("event").isin(SEARCH, RETURN), F.col("docs")).otherwise(F.array().cast("array<bigint>"))
    count = lambda e: F.coalesce(F.sum((F.col("event") == e).cast("int")).over(before), F.lit(0)).cast("int")
    rows = events.where(F.col("event") != END).select(
        "trajectory_id", "event", "cluster_id", F.coalesce(F.last(named, True).over(before), F.lit(ROOT)).alias("here"), F.array_distinct(F.flatten(F.collect_list(gave).over(before))).alias("evidence"),
        count(SEARCH).alias("retrieves"), count(RECURSE).alias("jumps"), F.row_number().over(order).alias("i"), named.alias("named"), gave.alias("gave"),
    )
    step = (F.row_number().over(Window.partitionBy("trajectory_id").orderBy("i")) - 1).cast("int")
    acts = rows.where(F.col("event").isin(RECURSE, SEARCH))
    jump = F.col("event") == RECURSE
    shown = acts.select("trajectory_id", step.alias("step"), F.when(jump, F.col("here")).otherwise(F.col("cluster_id")).alias("node_id"), F.when(jump, "JUMP").otherwise("RETRIEVE").alias("action"), F.col("cluster_id").alias("target"), "evidence", "retrieves", "jumps", F.lit(False).alias("done"))
    last = rows.groupBy("trajectory_id").agg(F.max(F.struct("i", F.coalesce("named", "here").alias("node_id"), F.array_distinct(F.concat("evidence", "gave")).alias("evidence"))).alias("x"), F.sum((F.col("event") == SEARCH).cast("int")).cast("int").alias("retrieves"), F.sum(jump.cast("int")).cast("int").alias("jumps"))
    last = last.where(F.col("retrieves") + F.col("jumps") > 0)
    ends = last.select("trajectory_id", (F.col("retrieves") + F.col("jumps")).cast("int").alias("step"), "x.node_id", F.lit("RETRIEVE").alias("action"), F.col("x.node_id").alias("target"), "x.evidence", "retrieves", "jumps", F.lit(True).alias("done"))
    return shown.unionByName(ends).withColumn("path", path_nodes(F.col("node_id")))


def fold(events: list[tuple]) -> list[tuple]:
    """ROWS of one trajectory's known events (seq, event, cluster_id, docs), in order, without its id."""
    here, evidence, out, calls = ROOT, [], [], {SEARCH: 0, RECURSE: 0}
    for _, event, node, docs in events:
        if event in calls:
            jump = event == RECURSE
            out.append((len(out), here if jump else node, "JUMP" if jump else "RETRIEVE", node, list(evidence), calls[SEARCH], calls[RECURSE], False))
            calls[event] += 1
        if event in (SEARCH, RETURN):
            evidence = list(dict.fromkeys([*evidence, *docs]))
        if event in (ENTER, RECURSE, SEARCH):
            here = node
    if out:
        out.append((len(out), here, "RETRIEVE", here, list(evidence), calls[SEARCH], calls[RECURSE], True))
    return out


def convert_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """ROWS of a stream of known() events with a time `at`: a trajectory's events are its state until its end."""
    names = [c.split(" ")[0] for c in ROWS.split(", ")]

    def step(key, batches, state):
        held = list(state.get[0]) if state.exists else []
        ended = state.hasTimedOut
        for batch in batches:
            for r in batch.itertuples(index=False):
                ended |= r.event == END
                held.append((int(r.seq), r.event, r.cluster_id, [int(d) for d in r.docs]))
        if not ended:
            state.update((held,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 3_600_000)
            return
        state.remove() if state.exists else None
        order = sorted((e for e in held if e[1] != END), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or "", e[3]))
        rows = fold([tuple(e) for e in order])
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    stream = events.withWatermark("at", late)
    return stream.groupBy("trajectory_id").applyInPandasWithState(step, ROWS, "held array<struct<seq:bigint,event:string,cluster_id:string,docs:array<bigint>>>", "append", "EventTimeTimeout")


ASKING = ("search_in_cluster", "rank_clusters_llm", "ground_query", "search_documents")


def distill(events: DataFrame, retrieved: DataFrame, snippets: int = 3, docs: int = 20) -> DataFrame:
    """What each trajectory did: distinct queries, nodes and final documents by first occurrence, the first code snippets, errors.

    events (trajectory_id, seq, event, query, cluster_id, code, error, docs); retrieved (trajectory_id, docs) stands in where no
    return gave documents.  Values are counted down to one row each before they are listed, and snippets limited by rank.
    """
    text = lambda c, n: F.substring(c, 1, n)
    code = F.regexp_replace("code", r"^\s+|\s+$", "")
    kinds = F.array(
        F.when(F.col("event").isin(*ASKING) & (F.col("query") != ""), F.struct(F.lit("queries").alias("kind"), F.array("query").alias("v"))),
        F.when(F.col("cluster_id") != "", F.struct(F.lit("clusters").alias("kind"), F.array("cluster_id").alias("v"))),
        F.when((F.col("event") == RETURN) & (F.size("docs") > 0), F.struct(F.lit("docs").alias("kind"), F.transform(F.slice("docs", 1, docs), lambda d: d.cast("string")).alias("v"))),
        F.when((F.col("event") == "generated_code") & (code != ""), F.struct(F.lit("snippets").alias("kind"), F.array(text(code, 1200)).alias("v"))),
        F.when((F.col("event") == "sandbox_result") & (F.col("error") != ""), F.struct(F.lit("errors").alias("kind"), F.array(text("error", 500)).alias("v"))),
    )
    rows = events.select("trajectory_id", "seq", F.explode(F.array_compact(kinds)).alias("k")).select("trajectory_id", "seq", "k.kind", F.posexplode("k.v").alias("i", "value"))
    rows = rows.withColumn("own", F.when(F.col("kind").isin("snippets", "errors"), F.col("seq")))  # those may recur
    first = rows.groupBy("trajectory_id", "kind", "value", "own").agg(F.min(F.struct("seq", "i")).alias("at"))
    place = F.row_number().over(Window.partitionBy("trajectory_id").orderBy("at"))
    few = first.where("kind = 'snippets'").withColumn("n", place).where(F.col("n") <= snippets).drop("n")
    listed = first.where("kind <> 'snippets'").unionByName(few)
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "value")))), lambda x: x["value"]).alias(kind)
    lists = listed.groupBy("trajectory_id").agg(*(of(k) for k in ("queries", "clusters", "docs", "snippets", "errors")))
    out = events.select("trajectory_id").distinct().join(lists, "trajectory_id", "left").join(retrieved.select("trajectory_id", F.slice("docs", 1, docs).cast("array<string>").alias("_r")), "trajectory_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({k: F.coalesce(k, none) for k in ("queries", "clusters", "snippets", "errors", "docs")})
    return out.withColumn("docs", F.when(F.size("docs") > 0, F.col("docs")).otherwise(F.array_distinct(F.coalesce("_r", none)))).drop("_r")


__all__ = ["convert", "convert_stream", "distill", "fold", "known"]
