"""Stored postings: an inverted index that is written once, and BM25 from it without reading a text again.

A posting list is cut into blocks of documents (a block of a document is the same for all terms), so a term that every document
has is many rows, and no row holds more than a block.  A block row (term, block, n, most_tf, least_size, docs, tfs, sizes)
bounds what its documents can score by their largest count and smallest size.  A block is some documents that follow one another in
a task, which writes all its rows: no posting is shuffled, and a task holds a block at a time.

Queries' terms go to the blocks, not the blocks to them, unless they are more than MOST_ASKED: then both are shuffled.
What of a block has an asked term is moved once, with its terms' queries, to be scored as one group (a group has at most
about SLICE queries).  A top-k search gets a block's first k of each query, so pairs of queries and documents are no rows;
documents that are given (within) meet their block and are the only ones that are scored for it.

A block has also a row without a term, which lists its documents (see places()).

Cases: documents without tokens count in the mean length; null ids are ids like others; repeated ids are one document that scores
what its rows score together (rows of one id should be one), and an index that has any is scored as a whole; an empty table
gives an empty index.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.layout import new_folder, spread

BLOCK_DOCS = 2048
BLOCK_TOKENS = 1 << 20  # a block of long documents has fewer
MOST_ASKED = 500_000  # (query, term) rows that are broadcast
SLICE = 1000  # queries that a block is scored for at a time
_ROWS = "term string, block bigint, n int, most_tf int, least_size int, total bigint, docs array<{id}>, tfs array<int>, sizes array<int>"
_PLACES = [c.split(" ")[0] for c in _ROWS.split(", ")]


def _blocks(batch: pa.RecordBatch, block_docs: int):
    """Slices of at most block_docs documents and, unless one document has more, BLOCK_TOKENS tokens."""
    ends = batch.column("tokens").offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        end = min(at + block_docs, int(np.searchsorted(ends, ends[at] + BLOCK_TOKENS, "right")) - 1)
        end = max(at + 1, end)
        yield batch.slice(at, end - at)
        at = end


def _posted(block_docs: int):
    """Rows (doc_id, tokens) to block rows."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _blocks(batch, block_docs):
                lists = part.column("tokens")
                size = np.diff(lists.offsets.to_numpy())
                words = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(size)), size)
                key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(size) + row, return_counts=True)
                every = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
                none = pa.array([None], pa.list_(pa.int32()))
                zero = [pa.array([0], pa.int32())] * 3
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([number]), *zero, pa.array([0], pa.int64()), every, none, none], _PLACES)
                if not len(key):
                    number += 1
                    continue
                term, of = np.divmod(key, len(size))
                first = np.flatnonzero(np.diff(term, prepend=-1))
                cuts = pa.array(np.append(first, len(key)), pa.int32())
                listed = lambda values, cuts=cuts: pa.ListArray.from_arrays(cuts, values)
                ints = lambda x: pa.array(x, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    words.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), number)), ints(np.diff(np.append(first, len(key)))), ints(np.maximum.reduceat(tf, first)), ints(np.minimum.reduceat(size[of], first)),
                    pa.array(np.add.reduceat(tf, first), pa.int64()), listed(part.column("doc_id").take(pa.array(of))), listed(ints(tf)), listed(ints(size[of])),
                ], _PLACES)
                number += 1

    return run


def _parts(spark: SparkSession) -> int:
    """Partitions by number, as a small index, which adaptive execution would gather in one task, is many rows to score."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class Postings:
    """An index in a folder: n documents of `mean` tokens; mean_raw is the mean idf of all terms before the floor."""

    spark: SparkSession
    folder: str
    n: int
    mean: float
    mean_raw: float
    n_blocks: int = 1
    repeated: bool = False

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks").where("term is not null")

    def places(self) -> DataFrame:
        """(doc_id, block) of every document."""
        return self.spark.read.parquet(f"{self.folder}/blocks").where("term is null").select(F.explode("docs").alias("doc_id"), "block")

    def terms(self) -> DataFrame:
        """(term, df, raw): raw is the idf before the floor."""
        return self.spark.read.parquet(f"{self.folder}/terms")


def build(docs: DataFrame, text: str = "text", folder: str | None = None, block_docs: int = BLOCK_DOCS) -> Postings:
    """Writes the index of docs (doc_id, text); texts are read once."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "postings")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", text)).select("doc_id", tokens(F.col(text)).alias("tokens")).mapInArrow(_posted(block_docs), _ROWS.format(id=kind))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(block_docs))  # a task's Python holds a block's texts, not five
    try:
        rows.write.parquet(f"{folder}/blocks")
    finally:
        spark.conf.set(key, before)
    n = docs.select("doc_id").count()
    repeated = not docs.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").isEmpty()
    n_blocks = max(1, -(-n // block_docs))
    written = spark.read.parquet(f"{folder}/blocks").where("term is not null")
    raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    written.groupBy("term").agg(F.sum("n").cast("bigint").alias("df"), F.sum("total").alias("total")).select("term", "df", "total", raw.alias("raw")).write.parquet(f"{folder}/terms")
    sums = spark.read.parquet(f"{folder}/terms").agg(F.sum("total").alias("total"), F.avg("raw").alias("raw")).first()
    return Postings(spark, folder, n, (sums["total"] or 0) / n if n else 0.0, sums["raw"] or 0.0, n_blocks, repeated)


@functools.lru_cache(64)
def _built(spark: SparkSession, _application: str, _files: tuple, path: str) -> Postings:
    return build(spark.read.parquet(path))


def of_table(spark: SparkSession, path: str) -> Postings:
    """The index of a table's documents: built at the first use in an application, and again when a file of it has changed."""
    from ..sources.layout import fingerprint

    return _built(spark, spark.sparkContext.applicationId, fingerprint(spark, path), path)


def idf(index: Postings, floor: float):
    return F.when(F.col("raw") < 0, F.lit(floor * index.mean_raw)).otherwise(F.col("raw"))


def _asked(index: Postings, queries: DataFrame, floor: float) -> DataFrame:
    """(query_id, term, weight) of queries' terms that the index has."""
    rows = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return rows.join(index.terms(), "term").select("query_id", "term", (F.col("times") * idf(index, floor)).alias("weight"))


def matching(index: Postings, rows: DataFrame, *columns: str) -> DataFrame:
    """Stored rows that have a term, with the blocks (or these columns of them) of their terms."""
    blocks = index.blocks().select("term", *columns) if columns else index.blocks()
    if rows.count() <= MOST_ASKED:
        return blocks.join(F.broadcast(rows), "term")
    return rows.repartition(_parts(index.spark), "term").join(blocks, "term")


def _block_scores(part, limit: int | None, kinds: pa.Schema):
    """A block's rows (asked, docs, tfs, sizes), and what is within, to each query's scores, its first `limit` if there is one."""

    def run(rows: pa.Table, within: pa.Table | None = None) -> pa.Table:
        from .dense import _rounded

        if not rows.num_rows or (within is not None and not within.num_rows):
            return kinds.empty_table()
        rows = rows.combine_chunks()
        lists, asked = (rows[c].chunk(0) for c in ("docs", "asked"))
        coded = lists.flatten().dictionary_encode("encode")
        docs, d = coded.dictionary, coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        p = part(rows["tfs"].chunk(0).flatten().to_numpy().astype(float), rows["sizes"].chunk(0).flatten().to_numpy())
        terms = asked.flatten()
        coded = terms.field("query_id").dictionary_encode("encode")
        queries, q = coded.dictionary, coded.indices.to_numpy()
        row, weight = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy())), terms.field("weight").to_numpy()
        order = np.argsort(q, kind="stable")
        cuts = np.searchsorted(q[order], np.arange(len(queries) + 1))
        place = np.empty(len(docs), int)
        place[pc.array_sort_indices(docs).to_numpy()] = np.arange(len(docs))
        place[docs.is_null().to_numpy(zero_copy_only=False)] = -1
        allowed = None
        if within is not None:
            at = pc.index_in(within["doc_id"], docs)
            known = at.is_valid().to_numpy()
            at = pc.fill_null(at, 0).to_numpy()
            if "query_id" in within.column_names:
                of = pc.fill_null(pc.index_in(within["query_id"], queries), -1).to_numpy()
                allowed = lambda k, whose=of: at[known & (whose == k)]
            else:
                allowed = lambda k, at=at[known]: at
        out = []
        for k in range(len(queries)):
            mine = order[cuts[k] : cuts[k + 1]]
            spans = [slice(ends[r], ends[r + 1]) for r in row[mine]]
            of = np.concatenate([d[x] for x in spans])
            total = np.bincount(of, np.concatenate([p[x] * w for x, w in zip(spans, weight[mine])]), len(docs))
            shared = np.zeros(len(docs), bool)
            shared[of] = True
            if allowed:
                inside = np.zeros(len(docs), bool)
                inside[allowed(k)] = True
                shared &= inside
            found = np.flatnonzero(shared)
            if limit is not None and len(found) > limit:
                s = total[found]
                found = found[s >= np.partition(s, len(s) - limit)[len(s) - limit] - 1e-8]
                if len(found) > limit:
                    found = found[np.lexsort((place[found], -_rounded(total[found])))[:limit]]
            out.append((np.full(len(found), k), found, total[found]))
        q, i, s = (np.concatenate(x) for x in zip(*out))
        return pa.table([queries.take(pa.array(q)), docs.take(pa.array(i)), pa.array(s)], schema=kinds)

    return run


def _scored(index: Postings, asked: DataFrame, part, limit: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of stored asked (query_id, term, weight): sums of weight * part(tf, size) by document, within a
    query's first `limit` in a block if there is one; within: (doc_id), or (query_id, doc_id), that are given."""
    from ..sources.layout import stored

    if index.repeated:
        limit = None  # a document's rows may be in several blocks
    n = asked.select("query_id").distinct().count()
    slices = max(1, -(-n // SLICE))
    of = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice")
    terms = asked.select("term", of, "query_id", "weight").groupBy("term", "slice").agg(F.collect_list(F.struct("query_id", "weight")).alias("asked"))
    rows = matching(index, stored(terms), "block", "docs", "tfs", "sizes").select("block", "slice", "asked", "docs", "tfs", "sizes")
    key, parts = ["block", "slice"], _parts(index.spark)
    rows = rows.repartition(parts, *key).groupBy(*key)
    empty = asked.select("query_id").limit(0).join(index.places().select("doc_id").limit(0)).withColumn("score", F.lit(0.0))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)
    run = _block_scores(part, limit, empty.toArrow().schema)
    if within is None:
        found = rows.applyInArrow(lambda t: run(t), kinds)
    else:
        given = within.select(*(c for c in ("query_id", "doc_id") if c in within.columns)).distinct()
        given = given.join(index.places().distinct(), "doc_id")
        given = given.withColumn("slice", of) if "query_id" in within.columns else given.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        found = rows.cogroup(given.repartition(parts, *key).groupBy(*key)).applyInArrow(lambda a, b: run(a, b), kinds)
    if index.repeated:
        found = found.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return found


def _bm25_part(index: Postings, k1: float, b: float):
    mean = index.mean or 1.0
    return lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


def scores(index: Postings, queries: DataFrame, k1: float, b: float, floor: float, within: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all pairs that share a term; within: (doc_id), or (query_id, doc_id), that are given."""
    return best(index, queries, k1, b, floor, None, within)


def best(index: Postings, queries: DataFrame, k1: float, b: float, floor: float, limit: int | None, within: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) that hold each query's first `limit` (of those within)."""
    from ..sources.layout import stored

    return _scored(index, stored(_asked(index, queries, floor)), _bm25_part(index, k1, b), limit, within)


def shared_terms(index: Postings, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) that hold each query's first `limit` by the share of its distinct tokens that a document has."""
    from ..sources.layout import stored

    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q")).select("query_id", F.size("q").alias("n"), F.explode("q").alias("term"))
    asked = stored(asked.select("query_id", "term", "n", F.lit(1.0).alias("weight")).distinct())
    found = _scored(index, asked, lambda tf, size: np.ones(len(tf)), limit)
    return found.join(asked.select("query_id", "n").distinct(), "query_id").select("query_id", "doc_id", (F.col("score") / F.col("n")).alias("score"))


__all__ = ["Postings", "best", "build", "idf", "matching", "of_table", "scores", "shared_terms"]
