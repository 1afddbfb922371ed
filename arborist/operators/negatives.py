"""Negatives for candidate lists: nodes near the query's centroid for rows that are scored badly, and other rows' positives.

Rows: row_id, query_id, candidates (array of string; padded with ''), mask, positive (arrays of 0 and 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .training import first_positive_rank


def _filled(candidates: Column, mask: Column, positive: Column, added: Column, sources: bool = False) -> list[Column]:
    """The lists with added nodes in place of padding, as far as there is any; lengths stay."""
    size = F.size(candidates)
    held = F.filter(F.arrays_zip(candidates.alias("c"), mask.alias("m"), positive.alias("p")), lambda x: x["m"] > 0)
    new = F.slice(added, F.lit(1), F.greatest(size - F.size(held), F.lit(0)))
    every = F.concat(F.transform(held, lambda x: F.struct(x["c"].alias("c"), F.lit(1).alias("m"), x["p"].alias("p"))), F.transform(new, lambda n: F.struct(n.alias("c"), F.lit(1).alias("m"), F.lit(0).alias("p"))))
    pad = F.array_repeat(F.struct(F.lit("").alias("c"), F.lit(0).alias("m"), F.lit(0).alias("p")), size - F.size(every))
    whole = F.concat(every, pad)
    return [F.transform(whole, lambda x: x["c"]).alias("candidates"), F.transform(whole, lambda x: x["m"]).alias("mask"), F.transform(whole, lambda x: x["p"]).alias("positive")]


def hard_negatives(rows: DataFrame, neighbours: DataFrame, top: int = 3, most: int = 5) -> DataFrame:
    """rows (with scores) whose best positive isn't among the top: up to `most` of the query's neighbours (query_id,
    node_id, rank) that aren't candidates take the place of padding.  Wrongly ranked candidates are in the list already,
    so neighbours are the only source."""
    bad = rows.withColumn("_r", first_positive_rank(F.col("scores"), F.col("mask"), F.col("positive"))).where(F.col("_r") > top).drop("_r")
    near = neighbours.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("_near"))
    joined = bad.join(near, "query_id", "left").withColumn("_new", F.slice(F.filter(F.coalesce("_near", F.array().cast("array<string>")), lambda n: ~F.array_contains("candidates", n)), 1, most))
    return joined.select("row_id", "query_id", *_filled(F.col("candidates"), F.col("mask"), F.col("positive"), F.col("_new")), F.least(F.size("_new"), F.size(F.filter("mask", lambda m: m == 0))).alias("added"))


def batch_negatives(rows: DataFrame, batch: str, path: str, most: int = 8) -> DataFrame:
    """rows with positives of other queries' rows of the same batch, not on the row's own path, in place of padding.

    Batches are a training step's rows, so a batch's positives are a short list that joins each of its rows.
    """
    positives = rows.select(batch, "query_id", F.explode(F.filter(F.arrays_zip(F.col("candidates").alias("c"), F.col("positive").alias("p")), lambda x: x["p"] > 0)).alias("x")).select(batch, F.struct("query_id", F.col("x.c").alias("c")).alias("o")).distinct()
    listed = positives.groupBy(batch).agg(F.array_sort(F.collect_list("o")).alias("_others"))
    mine = F.filter("_others", lambda o: (o["query_id"] != F.col("query_id")) & ~F.array_contains("candidates", o["c"]) & ~F.array_contains(path, o["c"]))
    joined = rows.join(listed, batch, "left").withColumn("_new", F.slice(F.array_distinct(F.transform(F.coalesce(mine, F.filter("_others", lambda _: F.lit(False))), lambda o: o["c"])), 1, most))
    return joined.select("row_id", "query_id", *_filled(F.col("candidates"), F.col("mask"), F.col("positive"), F.coalesce("_new", F.array().cast("array<string>"))))


def loop_mask(candidates: Column, mask: Column, positive: Column, node: Column, path: Column) -> Column:
    """1 for candidates that were visited (or are the node itself) and aren't positive."""
    rows = F.arrays_zip(candidates.alias("c"), mask.alias("m"), positive.alias("p"))
    return F.transform(rows, lambda x: ((x["m"] > 0) & (x["p"] == 0) & ((x["c"] == node) | F.array_contains(path, x["c"]))).cast("int"))
