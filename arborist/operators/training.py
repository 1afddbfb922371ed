"""Training data of navigation policies: weights, splits, state features, and losses and metrics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_weights(rows: DataFrame, action: str, classes: int = 3, known: list | None = None) -> DataFrame:
    """(action, n, weight): total / (classes * (n + 1)); known: all classes, of which some may not occur."""
    counts = rows.groupBy(action).agg(F.count("*").alias("n"))
    if known is not None:
        every = rows.sparkSession.createDataFrame([(k,) for k in known], f"{action} {rows.schema[action].dataType.simpleString()}")
        counts = every.join(counts, action, "left").fillna(0, ["n"])
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(action, "n", (F.col("total") / (classes * (F.col("n") + 1))).alias("weight"))


def done_weight(rows: DataFrame, done: Column) -> DataFrame:
    """One row: negatives a positive, 10 without positives."""
    return rows.agg(F.sum(done.cast("long")).alias("p"), F.count("*").alias("n")).select(F.when(F.coalesce("p", F.lit(0)) > 0, (F.col("n") - F.col("p")) / F.col("p")).otherwise(F.lit(10.0)).alias("weight"))


def sampler_weights(rows: DataFrame, key: str, action: str) -> DataFrame:
    """(key, weight): one over the action's count; counts are joined, as a window would gather an action in one task.

    Few actions' counts are broadcast by their size; with many, the join splits what a frequent action has."""
    counts = rows.groupBy(action).agg(F.count("*").alias("n"))
    return rows.join(counts, action).select(key, (1.0 / F.col("n")).alias("weight"))


def group_split(rows: DataFrame, group: str, share: float, seed: int = 42) -> DataFrame:
    """(group, validation): round(share * groups) groups, those that come first by a seeded hash.

    Groups are counted by the hash's first four digits (at most 65,536 numbers), which shows where the last one lies; only
    groups of that prefix are sorted.
    """
    groups = rows.select(group).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))))
    counts = sorted((r["p"], r["n"]) for r in groups.groupBy(F.substring("_h", 1, 4).alias("p")).agg(F.count("*").alias("n")).collect())
    left, last = round(share * sum(n for _, n in counts)), ""
    for last, n in counts:
        if left < n:
            break
        left -= n
    else:
        return groups.select(group, F.lit(bool(counts)).alias("validation"))
    edge = groups.where(F.substring("_h", 1, 4) == last).orderBy("_h", group).limit(left).select(group, F.lit(True).alias("_v"))
    before = F.substring("_h", 1, 4) < last
    return groups.join(edge, group, "left").select(group, (before | F.coalesce("_v", F.lit(False))).alias("validation"))


def looping(log: DataFrame, by: str, order: list[str], node: str, window: int = 6, repeat: int = 3) -> DataFrame:
    """log with `repeats`, how often the node occurs among the last window visits, and `loop`."""
    recent = F.collect_list(node).over(Window.partitionBy(by).orderBy(*order).rowsBetween(1 - window, 0))
    return log.withColumn("repeats", F.size(F.filter(recent, lambda x: x == F.col(node))).cast("bigint")).withColumn("loop", F.col("repeats") >= repeat)


#: What counts are divided by in state features (fixed values).
DIVISORS = {"depth": 16.0, "evidence": 100.0, "children": 8.0, "step": 16.0, "calls": 16.0}


def state_features(depth: Column, evidence: Column, children: Column, step: Column, size: Column) -> list[Column]:
    """Counts as shares of their divisors, at most 1, and the logarithm of the subtree's size."""
    parts = (("depth", depth), ("evidence", evidence), ("children", children), ("step", step))
    return [F.least(c / DIVISORS[n], F.lit(1.0)).alias(n) for n, c in parts] + [F.log1p(size.cast("double")).alias("log_size")]


def listwise_loss(scores: Column, mask: Column, positive: Column) -> Column:
    """log-sum-exp of the masked scores less that of the positives among them; null without positives."""
    rows = F.filter(F.arrays_zip(scores.alias("s"), mask.alias("m"), positive.alias("p")), lambda x: x["m"] > 0)

    def total(items):
        most = F.array_max(F.transform(items, lambda x: x["s"]))
        return most + F.log(F.aggregate(F.transform(items, lambda x: F.exp(x["s"] - most)), F.lit(0.0), lambda a, v: a + v))

    held = F.filter(rows, lambda x: x["p"] > 0)
    return F.when(F.size(held) > 0, total(rows) - total(held))


def loop_penalty(scores: Column, mask: Column, loops: Column) -> Column:
    """-log(1 - the masked candidates' share that would loop), at most that of 1 - 1e-6; null if none would."""
    rows = F.filter(F.arrays_zip(scores.alias("s"), mask.alias("m"), loops.alias("l")), lambda x: x["m"] > 0)
    most = F.array_max(F.transform(rows, lambda x: x["s"]))
    total = lambda items: F.aggregate(F.transform(items, lambda x: F.exp(x["s"] - most)), F.lit(0.0), lambda a, v: a + v)
    bad = F.filter(rows, lambda x: x["l"] > 0)
    return F.when(F.size(bad) > 0, -F.log1p(-F.least(total(bad) / total(rows), F.lit(1 - 1e-6))))


def done_loss(logit: Column, label: Column, positive_weight: float) -> Column:
    """Binary cross-entropy of a logit, positives weighted."""
    soft = F.log1p(F.exp(-F.abs(logit)))
    return positive_weight * label * (soft + F.greatest(-logit, F.lit(0.0))) + (1 - label) * (soft + F.greatest(logit, F.lit(0.0)))


def action_loss(logits: list[Column], label: Column, weights: list[float]) -> Column:
    """Cross-entropy of an action's logits times its class's weight; a mean divides by the sum of the weights."""
    most = F.greatest(*logits)
    total = sum((F.exp(x - most) for x in logits[1:]), F.exp(logits[0] - most))
    own, weight = F.get(F.array(*logits), label), F.get(F.array(*(F.lit(float(w)) for w in weights)), label)
    return weight * (most + F.log(total) - own)


def first_positive_rank(scores: Column, mask: Column, positive: Column) -> Column:
    """Rank (from 1) of the best positive among masked candidates, ties by place; null without one."""
    zipped = F.filter(F.arrays_zip(scores.alias("s"), mask.alias("m"), positive.alias("p")), lambda x: x["m"] > 0)
    order = F.array_sort(F.transform(zipped, lambda x, i: F.struct((-x["s"]).alias("s"), i.alias("i"), x["p"].alias("p"))))
    at = F.array_position(F.transform(order, lambda x: (x["p"] > 0).cast("int")), 1)
    return F.when(at > 0, at)


def learning_rate(step: Column, total: int, warmup: float = 0.05, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine from 1 down to floor."""
    first = max(1, int(warmup * total))
    progress = F.least((step - first) / max(1, total - first), F.lit(1.0))
    return F.when(step < first, F.greatest(step / first, F.lit(1e-8))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * progress)))
