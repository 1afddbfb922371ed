"""Phrase collocation mining: counts of all frequent phrases of 2 to 5 words by tries, and their most telling cuts.

Everything is per language.  A phrase is frequent if it occurs at least `least` times within pieces (texts are split at
punctuation and line ends).  As all parts of a frequent phrase are frequent, three readings of the texts suffice:

1. Words: every task counts its distinct words; Spark sums them up.  The words' hashes are held against their texts over
   the whole corpus, and if two words of a language share one, another seed is taken; so hashes name words exactly.
2. Pairs of neighbours that are both frequent words, as tries of depth 2.
3. Tries of depth 5 over chains of frequent pairs.

For each shard of whole texts, of about a million words, a task sorts the windows that start at each word; windows with common first
words are then neighbours, so the runs of equal first d words are the trie's nodes of depth d, and come out sorted (parents
before children).  Shards' sorted nodes are dealt by prefix range (language and first two words, whose random hashes
make ranges even), merged in order by Spark's external sort, and walked in one stream: equal nodes are added, and the last
node of each lesser depth is the ancestor, which gives the counts of the left parts.  Right parts are found by suffix
links: joins of a phrase's last words with the phrase that they are.

Which words and pairs are frequent reaches the tasks as bitmaps of 2^FILTER_BITS bits (2 MB), whatever the corpus: a phrase
that isn't frequent may pass and costs work, none is lost, and all occurrences of a phrase pass or none, so counts are exact.
What is shuffled are counts by shard: a hot word or pair is one row a shard.

Cases: a null text has no words; a null language is `und`; a language without frequent phrases gives no rows; empty tables
give empty results; repeated rows count as often as they occur; equal scores go by count, then by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import pick, stored
from .words import U, chunks, differing, mix, span_hashes

LEAST, LONGEST, TOP = 100, 5, 2000
FILTER_BITS = 24
SHARD_WORDS = 1_000_000  # from which on a trie isn't given more texts
MOST_DISTINCT = 1_000_000  # words that a task counts before it sends them on
UNKNOWN = "und"
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAKS
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PATH = [f"w{i}" for i in range(1, LONGEST + 1)]


@dataclass
class Tokens:
    """Words of one language: hashes, bytes, and places, of which neighbours in a piece follow one another without a gap."""

    lang: str
    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def _tokens(batches, seed: int) -> Iterator[Tokens]:
    base = 0
    for chunk in chunks(batches):
        starts, ends = chunk.words(_WORD)
        rows = chunk.row_of(starts)
        hashes = (span_hashes(chunk.data, starts, ends, True, seed) >> U(1)) | U(1)
        breaks = np.cumsum(_BREAKS[chunk.data])[starts] if len(starts) else np.zeros(0, np.int64)
        at = base + np.arange(len(starts)) + breaks + rows
        base = int(at[-1]) + 2 if len(at) else base
        langs = pc.fill_null(chunk.rows.column("lang"), UNKNOWN).dictionary_encode()
        of = langs.indices.to_numpy()[rows] if chunk.n else np.zeros(0, int)
        for k in np.unique(of).tolist():
            own = np.flatnonzero(of == k)
            yield Tokens(langs.dictionary[k].as_py(), hashes[own], at[own], starts[own], ends[own], chunk.data)


def _slot(lang: str, key: np.ndarray) -> np.ndarray:
    """The bit of a word or pair in a bitmap."""
    salt = U(int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little"))
    return (mix(key ^ mix(np.array([salt]))) >> U(64 - FILTER_BITS)).astype(np.int64)


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U(0x9E3779B97F4A7C15) + mix(second))


def _inside(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


# ---- words

def _count_words(seed: int):
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("slot", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def rows(lang, hashes, counts, texts):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(hashes)), pa.array(hashes.view(np.int64)), pa.array(_slot(lang, hashes)), texts, pa.array(counts)], schema=schema)

    def spelled(data, starts, ends):
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        places = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[places])])

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray, pa.Array]] = {}
        for t in _tokens(batches, seed):
            data = _LOWER[t.data]
            new, first, inverse, n = np.unique(t.hashes, return_index=True, return_inverse=True, return_counts=True)
            odd = differing(data, t.starts, t.ends, first, inverse)
            if len(odd):  # Spark then sees several words of a hash
                yield rows(t.lang, t.hashes[odd], np.zeros(len(odd), np.int64), spelled(data, t.starts[odd], t.ends[odd]))
            texts = spelled(data, t.starts[first], t.ends[first])
            if t.lang in held:
                hashes, counts, known = held[t.lang]
                at = np.minimum(np.searchsorted(hashes, new), len(hashes) - 1)
                old = hashes[at] == new
                old[old] = pc.equal(known.take(pa.array(at[old])), texts.filter(pa.array(old))).to_numpy(zero_copy_only=False)
                counts[at[old]] += n[old]
                fresh = np.flatnonzero(~old)
                hashes, counts = np.concatenate([hashes, new[fresh]]), np.concatenate([counts, n[fresh]])
                order = np.argsort(hashes, kind="stable")
                texts = pa.concat_arrays([known, texts.take(pa.array(fresh))]).take(pa.array(order))
                held[t.lang] = hashes[order], counts[order], texts
            else:
                held[t.lang] = new, n.astype(np.int64), texts
            if sum(len(x[0]) for x in held.values()) > MOST_DISTINCT:
                yield from (rows(lang, *x) for lang, x in held.items())
                held = {}
        yield from (rows(lang, *x) for lang, x in held.items())

    return run


def _words(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, h, slot, word and n of all words, and the seed by which hashes name words exactly."""
    for seed in range(16):
        counted = docs.mapInArrow(_count_words(seed), "lang string, h bigint, slot bigint, word string, n bigint")
        words = stored(counted.repartition("lang", "h").groupBy("lang", "h", "slot", "word").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("lang", "h").count().where("count > 1").isEmpty():
            return words, seed
    raise ValueError("no seed tells the words apart")


def _bitmap(slots: DataFrame) -> np.ndarray:
    """A bitmap of a column `slot`: 2^FILTER_BITS bits whatever there is to mark."""
    # both functions count from 1; a bucket has 32,768 bits
    one = F.col("slot") + 1
    buckets = slots.groupBy(F.bitmap_bucket_number(one).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in buckets.toLocalIterator():
        at = (r.b - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


# ---- tries

def _nodes(hashes: np.ndarray, link: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths (zeros fill) and counts of the trie of all chains of 2 to depth words, in order; link: a word goes on to the next."""
    reach = np.ones(len(hashes), np.int64)
    for _ in range(depth - 1):
        reach[:-1] = np.where(link[:-1], np.minimum(reach[1:] + 1, depth), 1)
    vocabulary, place = np.unique(hashes, return_inverse=True)
    at = np.flatnonzero(reach > 1)
    columns = [np.where(reach[at] > d, place[np.minimum(at + d, len(place) - 1)] + 1, 0) for d in range(depth)]
    columns += [np.zeros(len(at), np.int64)] * (LONGEST - depth)
    if len(vocabulary) < 1 << 21:
        high = (columns[0] << 42) | (columns[1] << 21) | columns[2]
        low = (columns[3] << 21) | columns[4]
        order = np.lexsort((low, high)) if depth > 3 else np.argsort(high, kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    sorted_columns = [c[order] for c in columns]
    new = np.zeros(len(at), bool)
    new[:1] = True
    paths, counts, firsts = [], [], []
    names = np.append(U(0), vocabulary)
    for d, column in enumerate(sorted_columns[:depth]):
        new[1:] |= column[1:] != column[:-1]
        if not d:
            continue
        edges = np.flatnonzero(new)
        size = np.diff(np.append(edges, len(at)))
        edges, size = edges[column[edges] > 0], size[column[edges] > 0]
        path = np.zeros((len(edges), LONGEST), U)
        for i in range(d + 1):
            path[:, i] = names[sorted_columns[i][edges]]
        paths.append(path)
        counts.append(size)
        firsts.append(edges * LONGEST + d)
    order = np.argsort(np.concatenate(firsts), kind="stable")
    return np.concatenate(paths)[order], np.concatenate(counts)[order]


def _tries(seed: int, depth: int, words, pairs=None):
    """Sorted trie nodes of each shard: lang, w1 .. w5, n."""
    schema = pa.schema([("lang", pa.string()), *((w, pa.int64()) for w in PATH), ("n", pa.int64())])

    def flushed(held):
        for lang, parts in held.items():
            hashes, at = (np.concatenate(x) for x in zip(*parts))
            link = np.append(at[1:] - at[:-1] == 1, False)
            if pairs is not None:
                i = np.flatnonzero(link)
                link[i] = _inside(pairs.value, _slot(lang, _pair_key(hashes[i], hashes[i + 1])))
            path, n = _nodes(hashes, link, depth)
            for a in range(0, len(n), 100_000):
                p = np.ascontiguousarray(path[a : a + 100_000].T).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * p.shape[1]), *map(pa.array, p), pa.array(n[a : a + 100_000])], schema=schema)

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for t in _tokens(batches, seed):
            some = np.flatnonzero(_inside(words.value, _slot(t.lang, t.hashes)))
            held.setdefault(t.lang, []).append((t.hashes[some], t.at[some]))
            size += len(some)
            if size >= SHARD_WORDS:
                yield from flushed(held)
                held, size = {}, 0
        yield from flushed(held)

    return run


def _walk(least: int):
    """Merged sorted nodes: adds up equal ones; gives frequent ones with the counts of their first 2, 3 and 4 words."""
    schema = pa.schema([("lang", pa.string()), *((w, pa.int64()) for w in PATH), ("a", pa.int64()), *((f"l{k}", pa.int64()) for k in range(2, LONGEST))])

    def run(batches):
        pending = None  # the last node, which may go on in the next batch: (lang, path, n)
        above = dict.fromkeys(range(2, LONGEST), 0)

        def ended(langs, path, n):
            depth = (path > 0).sum(1)
            left = []
            for k in range(2, LONGEST):
                last = np.maximum.accumulate(np.where(depth == k, np.arange(len(n)), -1))
                found = np.where(last >= 0, n[last], above[k])
                left.append(pa.array(found, mask=depth <= k))
                above[k] = int(found[-1])
            batch = pa.RecordBatch.from_arrays([langs, *(pa.array(np.ascontiguousarray(c)) for c in path.T), pa.array(n), *left], schema=schema)
            return batch.filter(pa.array(n >= least))

        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang")
            path = np.stack([batch.column(w).to_numpy() for w in PATH], 1)
            n = batch.column("n").to_numpy().astype(np.int64)
            if pending is not None:
                langs = pa.concat_arrays([pa.array([pending[0]]), langs])
                path, n = np.concatenate([pending[1][None], path]), np.append(pending[2], n)
            codes = langs.dictionary_encode().indices.to_numpy()
            new = np.append(True, (path[1:] != path[:-1]).any(1) | (codes[1:] != codes[:-1]))
            edges = np.flatnonzero(new)
            total = np.add.reduceat(n, edges)
            pending = langs[edges[-1]].as_py(), path[edges[-1]].copy(), int(total[-1])
            if len(edges) > 1:
                yield ended(langs.take(pa.array(edges[:-1])), path[edges[:-1]], total[:-1])
        if pending is not None:
            yield ended(pa.array([pending[0]]), pending[1][None], np.array([pending[2]]))

    return run


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, w1 .. w5, a, l2, l3, l4), and all words (lang, h, slot, word, n)."""
    spark = docs.sparkSession
    docs = pick(docs, text="string", lang="string")
    words, seed = _words(docs)
    schema = "lang string, " + ", ".join(f"{w} bigint" for w in PATH) + ", n bigint"
    frequent = spark.sparkContext.broadcast(_bitmap(words.where(F.col("n") >= least).select("slot")))
    pairs = docs.mapInArrow(_tries(seed, 2, frequent), schema).groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    marked = spark.sparkContext.broadcast(_bitmap(pairs.select("lang", "w1", "w2").mapInArrow(_pair_slots, "slot bigint")))
    nodes = docs.mapInArrow(_tries(seed, LONGEST, frequent, marked), schema)
    walked = nodes.repartition("lang", "w1", "w2").sortWithinPartitions("lang", *PATH)
    walked = walked.mapInArrow(_walk(least), "lang string, " + ", ".join(f"{c} bigint" for c in [*PATH, "a", "l2", "l3", "l4"]))
    return stored(walked, "phrases"), words


def _pair_slots(batches):
    for batch in batches:
        key = _pair_key(*(batch.column(c).to_numpy().view(U) for c in ("w1", "w2")))
        langs = batch.column("lang").dictionary_encode()
        codes, out = langs.indices.to_numpy(), np.zeros(batch.num_rows, np.int64)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            out[codes == k] = _slot(lang, key[codes == k])
        yield pa.RecordBatch.from_arrays([pa.array(out)], ["slot"])


def _part(first: int, last) -> list:
    """The path of words first to last (from 1; last a column or number)."""
    return [F.when(F.lit(i + first) <= last, F.get(F.col("path"), F.lit(i + first - 1))).otherwise(F.lit(0)).alias(w) for i, w in enumerate(PATH)]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first `top` phrases that no longer one makes idle."""
    found, words = phrases(docs, least)
    found = found.withColumn("path", F.array(*PATH)).withColumn("m", sum((F.col(w) > 0).cast("int") for w in PATH))
    longer = found.where("m > 2")
    inside = longer.select("lang", "a", *_part(1, F.col("m") - 1)).unionByName(longer.select("lang", "a", *_part(2, F.col("m"))))
    inside = inside.groupBy("lang", *PATH).agg(F.max("a").alias("longer"))
    # a phrase occurs at least as often as any longer one, so the longer ones by one word decide
    kept = found.join(inside, ["lang", *PATH], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    single = words.where(F.col("n") >= least).select("lang", F.col("h").alias("w1"), *(F.lit(0).cast("bigint").alias(w) for w in PATH[1:]), F.col("n").alias("f"))
    every = found.select("lang", *PATH, F.col("a").alias("f")).unionByName(single)
    first = single.select("lang", "w1", F.col("f").alias("l1"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    cuts = kept.join(first, ["lang", "w1"]).select("lang", "path", "m", "a", F.posexplode(F.slice(F.array("l1", "l2", "l3", "l4"), F.lit(1), F.col("m") - 1)).alias("k", "l"))
    suffix = [F.get(F.col("path"), F.col("k") + i) for i in range(1, LONGEST + 1)]
    cuts = cuts.select("lang", "path", "m", "a", "k", "l", *(F.coalesce(c, F.lit(0)).alias(w) for w, c in zip(PATH, suffix)))
    cuts = cuts.join(every, ["lang", *PATH]).withColumnRenamed("f", "r").join(total, "lang")
    up = (1000 * F.col("a")).cast("decimal(18,0)") * F.col("n").cast("decimal(19,0)")
    down = F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.call_function("div", up, down).cast("bigint"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "path", "a", "n").agg(least_cut)
    spelled = scored.select("lang", "path", F.posexplode(F.filter("path", lambda h: h > 0)).alias("i", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = scored.join(spelled, ["lang", "path"])
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


__all__ = ["collocations", "phrases"]
