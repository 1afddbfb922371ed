"""Quality rules: text statistics, and the perplexity of a modified Kneser-Ney model in bands of each language.

The model is over the bytes of words (A-Z folded, a blank before and after each), up to ORDER bytes.  Spark counts every
n-gram of every document: raw counts at the highest order and for n-grams that begin a word, numbers of distinct
preceding bytes otherwise.  No n-gram is left out.  Tasks hold sorted arrays of packed n-grams (at most 5 bytes and so
exact) with log probabilities and back-off weights: of each order all, or, where they are more than MAX_ENTRIES, the most
frequent (those of at least the least power of two that so many have), so what a task holds has a fixed bound.  Then the
whole model is a table in the shared folder, made by joins, and what a text has of n-grams that tasks don't hold is looked
up there, n-gram by n-gram with its back-off; the scores are those of the whole model.
Verdicts use a model of the texts that pass the base rule and have at most one symbol (#*$%&|<>) in ten words: junk that
recurs in a corpus would otherwise be learnt, and be as probable as its good texts.  All texts are scored and judged.

A document is rejected if its log perplexity lies outside [q1 - width * (q3 - q1), q3 + width * (q3 - q1)] of its
language's documents that pass the base rule; a null language is one of its own.  As a short text's mean is noisy, its
distance from the quartiles counts sqrt(n_words / (n_words + 100)) of itself.

Cases: null and empty texts have no words and fail the base rule; repeated rows and null ids are rows like others; an
empty table gives an empty result; columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

import functools
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import pick, stored
from .words import SMALL_CHUNK, SPACES, U, chunks, held, let_go, mix, per_row, span_hashes

ORDER = 5
MAX_ENTRIES = 1_000_000
WINDOW = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_stats(chunk, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The columns of _STATS, by row."""
    n = chunk.n
    starting = np.zeros(len(chunk.data) + 1, np.int64)
    starting[starts] = 1
    n_words = per_row(rows, n)
    word_chars = chunk.sums(~SPACES & ~_CONTINUES)
    # lines with a word: all after the first of equal ones
    a, b = chunk.words(_NEWLINE)
    before = np.concatenate([[0], np.cumsum(starting)])
    full = before[b] > before[a]
    lines = chunk.row_of(a)
    # a word may run on from an earlier line only where the line has its own start, as \n ends words
    a, b, lines = a[full], b[full], lines[full]
    dup = per_row(lines, n) - _distinct(span_hashes(chunk.data, a, b), lines, n)
    # words within repeated windows
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        h = span_hashes(chunk.data, starts, ends)
        m = len(h) - WINDOW + 1
        key = np.zeros(m, U)
        for k in range(WINDOW):
            key = key * U(0x9E3779B97F4A7C15) + h[k : k + m]
        key = mix(key) ^ mix(rows[:m].astype(U) + U(1))
        at = np.flatnonzero(rows[:m] == rows[WINDOW - 1 :])
        _, inverse, count = np.unique(key[at], return_inverse=True, return_counts=True)
        found = at[count[inverse] > 1]
        np.add.at(cover, found, 1)
        np.add.at(cover, found + WINDOW, -1)
    repeat = per_row(rows[np.cumsum(cover)[:-1] > 0], n)
    return np.stack([n_words, word_chars, chunk.sums(_SYMBOLS), dup, repeat])


def _distinct(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each row, how many distinct hashes it has."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return per_row(rows[first], n)


def _padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' folded bytes, each with a blank before and after, and their offsets."""
    size = ends - starts + 2
    offsets = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts + 1, size)
    out = _FOLD[data[np.clip(source, 0, max(0, len(data) - 1))]] if len(data) else np.zeros(0, np.uint8)
    out[offsets[:-1]] = out[offsets[1:] - 1] = 32
    return out, offsets


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte after a word's first: the n-gram that ends there (packed), its order, and its word."""
    size = np.diff(offsets)
    word = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(data)) - offsets[:-1][word]
    order = np.minimum(nth + 1, ORDER)
    key = np.zeros(len(data), np.int64)
    wide = data.astype(np.int64)
    for k in range(ORDER):
        here = np.zeros(len(data), np.int64)
        here[k:] = wide[: len(data) - k]
        key += np.where(k < order, here << (8 * k), 0)
    keep = nth > 0
    return key[keep], order[keep], word[keep]


def _unique_words(chunk, starts, ends):
    """First place of each distinct (folded) word, which of them each word is, and counts."""
    h = span_hashes(chunk.data, starts, ends, True)
    _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, count


def _fails(n_words, n_repeat_words):
    """The base rule, for columns as for arrays."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _count(batches, passing: bool = False):
    """(order, gram, n): sums of raw counts within the task, passed on before they grow large; passing: of texts that pass the base rule and have at most a symbol in ten words."""
    let_go()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        keys, inverse = np.unique(keys, return_inverse=True)
        return keys, np.bincount(inverse, counts).astype(np.int64)

    def batch(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array((keys >> 40).astype(np.int32)), pa.array(keys & ((1 << 40) - 1)), pa.array(counts)], ["k", "gram", "n"])

    for chunk in chunks(batches, SMALL_CHUNK):
        starts, ends = chunk.words(~SPACES)
        if passing:
            rows = chunk.row_of(starts)
            stats = base_stats(chunk, starts, ends, rows)
            good = (~_fails(stats[0], stats[-1]) & (10 * stats[2] <= stats[0]))[rows]  # by _STATS: words, symbols, repeats
            starts, ends = starts[good], ends[good]
        if not len(starts):
            continue
        first, _, count = _unique_words(chunk, starts, ends)
        key, order, word = _grams(*_padded(chunk.data, starts[first], ends[first]))
        key |= order << 40
        key, inverse = np.unique(key, return_inverse=True)
        parts.append((key, np.bincount(inverse, count[word]).astype(np.int64)))
        size += len(key)
        if size > 1_000_000:
            parts = [merged()]
            size = len(parts[0][0])
            if size > 500_000:
                yield batch(*parts[0])
                parts, size = [], 0
    if parts:
        yield batch(*merged())


class CharModel:
    """Interpolated modified Kneser-Ney over packed n-grams; by order: gram has sorted n-grams and log p, back contexts and log weights.

    An order without back is held in part: what it doesn't have is looked up in `rest`, (grams, contexts) tables by order.
    """

    def __init__(self, base: np.ndarray, gram: dict, back: dict, rest: dict[int, tuple[DataFrame, DataFrame]] | None = None):
        self.base, self.gram, self.back, self.rest = base, gram, back, rest

    def __getstate__(self):
        return {**self.__dict__, "rest": None}  # tables don't go to tasks

    @classmethod
    def whole(cls, orders: dict[int, tuple[np.ndarray, np.ndarray, tuple[float, float, float]]]) -> CharModel:
        """orders: for each k all grams (sorted), their counts, and discounts."""
        m = cls(np.full(256, -np.log(256.0)), {}, {})
        for k in range(1, ORDER + 1):
            gram, count, d = orders[k]
            context, first, of = np.unique(gram >> 8, return_index=True, return_inverse=True)
            total = np.bincount(of, count, len(context))[of]
            part = (count - np.asarray(d)[np.clip(count.astype(int), 1, 3) - 1]) / np.maximum(total, 1)
            kept = np.add.reduceat(part, first) if len(gram) else part
            back = np.clip(1 - kept, 1e-9, 1)
            if k == 1:
                p = np.full(256, (back[0] if len(back) else 1.0) / 256)
                p[gram] += part
                m.base = np.log(p)
                continue
            lower = np.exp(m.log_p(k - 1, gram & _below(k)))
            m.back[k] = context, np.log(back)
            m.gram[k] = gram, np.log(part + back[of] * lower)
        return m

    def look_up(self, k: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of the last byte's probability after the others; where that of an n-gram that isn't held is to be added, its key (order << 40 | n-gram), else 0."""
        if k == 1 or not len(grams):
            return self.base[grams], np.zeros(len(grams), np.int64)
        keys, values = self.gram[k]
        at = np.minimum(np.searchsorted(keys, grams), max(0, len(keys) - 1))
        found = keys[at] == grams if len(keys) else np.zeros(len(grams), bool)
        out, asked = np.zeros(len(grams)), np.zeros(len(grams), np.int64)
        out[found] = values[at[found]]
        rest = grams[~found]
        if not len(rest):
            return out, asked
        if k not in self.back:
            asked[~found] = (k << 40) | rest
            return out, asked
        context, back = self.back[k]
        lower, asked[~found] = self.look_up(k - 1, rest & _below(k))
        if len(context):
            at = np.minimum(np.searchsorted(context, rest >> 8), len(context) - 1)
            lower = lower + np.where(context[at] == rest >> 8, back[at], 0.0)
        out[~found] = lower
        return out, asked

    def log_p(self, k: int, grams: np.ndarray) -> np.ndarray:
        """look_up() of a model that is held as a whole."""
        return self.look_up(k, grams)[0]


def _below(k: int) -> int:
    """A mask of an n-gram's last k - 1 bytes."""
    return (1 << (8 * (k - 1))) - 1


def _tables(own: DataFrame, below: DataFrame, k: int, d: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(gram, n, p) and (context, back) of an order, of its own counts (gram, n) and the (gram, p) of the order below."""
    own = own.withColumn("context", F.shiftright("gram", 8)).withColumn("part", F.col("n") - F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]))
    contexts = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("part").alias("kept"))
    contexts = stored(contexts.select("context", "total", F.least(F.greatest(1 - F.col("kept") / F.col("total"), F.lit(1e-9)), F.lit(1.0)).alias("back")), f"contexts{k}")
    lower = below.select(F.col("gram").alias("end"), F.col("p").alias("lower"))
    grams = own.join(contexts, "context").withColumn("end", F.col("gram").bitwiseAND(F.lit(_below(k)))).join(lower, "end")
    return stored(grams.select("gram", "n", (F.col("part") / F.col("total") + F.col("back") * F.col("lower")).alias("p")), f"table{k}"), contexts.select("context", "back")


def fit(docs: DataFrame, max_entries: int = MAX_ENTRIES, passing: bool = False) -> CharModel:
    """The model of all words of docs (text); passing: only of those that pass the base rule and have at most a symbol in ten words."""
    raw = stored(docs.select("text").mapInArrow(functools.partial(_count, passing=passing), "k int, gram bigint, n bigint").groupBy("k", "gram").agg(F.sum("n").alias("n")), "grams")
    counts, discounts, least, above = {}, {}, {}, None
    for k in range(ORDER, 0, -1):
        own = raw.where(F.col("k") == k).select("gram", "n")
        if above is not None:
            # grams that begin a word can't be preceded within it; they have their raw counts
            more = above.select((F.col("gram").bitwiseAND(F.lit(_below(k + 1)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
            own = own.unionByName(more).groupBy("gram").agg(F.sum("n").alias("n"))
        own = stored(own, f"grams{k}") if 1 < k < ORDER else own
        sizes = {r["bits"]: r for r in own.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("of"), *(F.sum((F.col("n") == i).cast("bigint")).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()}
        n1, n2, n3, n4 = (sum(r[f"n{i}"] for r in sizes.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        discounts[k] = tuple(float(np.clip(i + 1 - (i + 2) * y * b / a if a else (i + 1) * y, 0.05, i + 0.95)) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4))))
        bits = max(sizes, default=0) + 1  # counts of at least 2 ** (bits - 1) are held
        of = 0
        while bits > 1 and (k == 1 or of + (sizes[bits - 1]["of"] if bits - 1 in sizes else 0) <= max_entries):
            bits -= 1
            of += sizes[bits]["of"] if bits in sizes else 0
        counts[k], least[k], above = own, 1 << (bits - 1), own
    if max(least.values()) == 1:
        return CharModel.whole({k: (*_sorted(counts[k], "n"), discounts[k]) for k in counts})
    spark = docs.sparkSession
    none = np.zeros(0, np.int64), np.zeros(0)
    base = CharModel.whole({**{k: (*none, discounts[k]) for k in counts}, 1: (*_sorted(counts[1], "n"), discounts[1])}).base
    m, below = CharModel(base, {}, {}, {}), spark.createDataFrame(list(enumerate(np.exp(base).tolist())), "gram bigint, p double")
    for k in range(2, ORDER + 1):
        grams, contexts = m.rest[k] = _tables(counts[k], below, k, discounts[k])
        gram, p = _sorted(grams.where(F.col("n") >= least[k]), "p")
        m.gram[k], below = (gram, np.log(p)), grams
        if least[k] == 1:
            context, back = _sorted(contexts, "back", "context")
            m.back[k] = context, np.log(back)
    return m


def _sorted(rows: DataFrame, value: str, key: str = "gram") -> tuple[np.ndarray, np.ndarray]:
    """Two columns on the driver, sorted by the key; for what tasks hold."""
    found = rows.select(key, F.col(value).cast("double").alias(value)).toArrow()
    keys, values = (found.column(c).to_numpy() for c in (key, value))
    order = np.argsort(keys)
    return keys[order], values[order]


def _looked_up(asked: DataFrame, model: CharModel) -> DataFrame:
    """(key, log_p) of distinct keys of n-grams that tasks don't hold, by joins with the whole model, order by order."""
    mask, rest, done = F.lit((1 << 40) - 1), None, []
    for k in range(ORDER, 1, -1):
        grams, contexts = model.rest[k]
        own = asked.where(F.shiftright("key", 40) == k).select("key", F.col("key").bitwiseAND(mask).alias("gram"), F.lit(0.0).alias("by"))
        found = stored((own if rest is None else own.unionByName(rest)).join(grams.select("gram", "p"), "gram", "left"), f"asked{k}")
        done.append(found.where("p is not null").select("key", (F.col("by") + F.log("p")).alias("log_p")))
        rest = found.where("p is null").withColumn("context", F.shiftright("gram", 8)).join(contexts, "context", "left")
        rest = rest.select("key", F.col("gram").bitwiseAND(F.lit(_below(k))).alias("gram"), (F.col("by") + F.coalesce(F.log("back"), F.lit(0.0))).alias("by"))
    base = F.get(F.array(*(F.lit(float(x)) for x in model.base)), F.col("gram").cast("int"))
    return functools.reduce(DataFrame.unionByName, done, rest.select("key", (F.col("by") + base).alias("log_p")))


def _model(packed: bytes) -> CharModel:
    return held(("perplexity", packed), lambda: pickle.loads(zlib.decompress(packed)))


def score(docs: DataFrame, model: CharModel) -> DataFrame:
    """doc_id, lang, the statistics, n_grams (predicted bytes) and log_ppl (natural log perplexity a byte; null without words)."""
    packed = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1))

    def run(batches):
        m = _model(packed.value)
        for chunk in chunks(batches, SMALL_CHUNK):
            starts, ends = chunk.words(~SPACES)
            rows = chunk.row_of(starts)
            stats = base_stats(chunk, starts, ends, rows)
            first, inverse, _ = _unique_words(chunk, starts, ends)
            key, order, word = _grams(*_padded(chunk.data, starts[first], ends[first]))
            lp, asked = np.empty(len(key)), np.zeros(len(key), np.int64)
            for k in range(2, ORDER + 1):
                lp[order == k], asked[order == k] = m.look_up(k, key[order == k])
            total, size = np.bincount(word, lp, len(first)), np.bincount(word, minlength=len(first))
            size = per_row(rows, chunk.n, size[inverse])
            total = per_row(rows, chunk.n, total[inverse])
            ppl = -total / np.maximum(size, 1)
            arrays = [chunk.rows.column("doc_id"), chunk.rows.column("lang"), *map(pa.array, stats), pa.array(size.astype(np.int64)), pa.array(ppl, mask=size == 0), _lists_of(asked, word, rows, inverse, chunk.n)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "lang", *_STATS, "n_grams", "log_ppl", "asked"]
    columns = ", ".join(f"{c} bigint" for c in (*_STATS, "n_grams"))
    scored = docs.mapInArrow(run, f"doc_id bigint, lang string, {columns}, log_ppl double, asked array<struct<key:bigint,times:bigint>>")
    if not model.rest:
        return scored.drop("asked")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = scored.select("row", F.explode("asked").alias("x")).select("row", "x.key", "x.times")
    more = asked.join(_looked_up(asked.select("key").distinct(), model), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("more"))
    ppl = F.col("log_ppl") - F.coalesce("more", F.lit(0.0)) / F.col("n_grams")
    return scored.join(more, "row", "left").withColumn("log_ppl", ppl).select(*names[:-1])


def _lists_of(asked: np.ndarray, word: np.ndarray, rows: np.ndarray, inverse: np.ndarray, n: int) -> pa.Array:
    """For each row the keys that its words ask for, with their numbers; asked: of each n-gram of the distinct words, 0 for none."""
    at = np.flatnonzero(asked)
    keys, of = np.unique(asked[at], return_inverse=True)
    size = np.bincount(word[at], minlength=int(inverse.max(initial=-1)) + 1)
    first = np.cumsum(size) - size
    held = np.flatnonzero(size[inverse]) if len(at) else at
    times = size[inverse[held]]
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[inverse[held]], times)
    pairs, count = np.unique(np.repeat(rows[held], times) * max(1, len(keys)) + of[place], return_counts=True)
    row, key = np.divmod(pairs, max(1, len(keys)))
    cuts = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(keys[key], pa.int64()), pa.array(count.astype(np.int64))], ["key", "times"]))


def quality_rules(docs: DataFrame, width: float = 4.0, least_spread: float = 0.02) -> DataFrame:
    """doc_id, lang, the statistics, log_ppl, base_failed and kept, for every row of docs (doc_id, text, lang)."""
    docs = pick(docs, doc_id="bigint", text="string", lang="string")
    rows = stored(score(docs, fit(docs, passing=True)), "quality").withColumn("lang", F.coalesce("lang", F.lit("und")))
    rows = rows.withColumn("base_failed", _fails(F.col("n_words"), F.col("n_repeat_words")))
    q = rows.where(~F.col("base_failed")).groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10_000).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(least_spread)) * width
    bands = stored(q.select("lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), spread.alias("spread")), "bands")  # a row a language, which Spark joins by its size
    sure = F.sqrt(F.col("n_words") / (F.col("n_words") + 100.0))
    inside = ((F.col("log_ppl") - F.col("q3")) * sure <= F.col("spread")) & ((F.col("q1") - F.col("log_ppl")) * sure <= F.col("spread"))
    good = F.coalesce(inside, F.lit(False))
    return rows.join(bands, "lang", "left").withColumn("kept", ~F.col("base_failed") & good)


__all__ = ["CharModel", "base_stats", "fit", "quality_rules", "score"]
