"""Language-model scoring by Brown's class-based bigrams.

Spark counts every word and every pair of neighbouring units of the training texts.  A unit is a word that makes up at
least 1/UNITS of all tokens, and the last two bytes of any other word; so there are at most UNITS frequent words and
65,536 endings at every size.  Exchange clustering assigns units to classes: units are moved, one by one, to the class
that raises the likelihood of the class bigrams most, until few moves are left.  With these classes fixed, every other word
of LEAST occurrences and at least 1/KNOWN of the tokens (at most KNOWN words) is exchanged once: Spark counts the classes on both its sides, and it
moves to the class that makes it and its neighbours likeliest.  Words rarer than that have their ending's class.  Class
transitions and emissions are counted again by the final classes.

    P(w | v) = (1 - mix) * P(class of w | class of v) * P(w | its class) + mix * base(w)

Emissions are discounted absolutely; what is taken off is the probability of a word of that class that training hasn't
seen.  Class transitions are smoothed by class frequencies.  base is the add-0.1 unigram.  As in base, where all unseen
words share a slot, unseen words of a class share one; known words' and these slots' probabilities sum to 1.

Words' counts are unbounded data, so they stay a distributed table: tasks hold only those of words with at least
1/KNOWN of all tokens (at most KNOWN numbers) and send other words' occurrences to be joined by hash.

Tokens: A-Z folded, words `[^\\x20\\x09-\\x0D]+`, then one end.  Words are told apart by 64-bit hashes.

Cases: null and empty texts are one end token; without training texts every count is 0; texts that occur again are
scored once a chunk and joined back to all their rows; null ids are rows like others; further columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import documents_only, pick, stored
from .words import SPACES, U, chunks, per_row, span_hashes

UNITS = 10_000
PAIRS = 1_000_000
KNOWN = 500_000
LEAST = 8
CLASSES = 64
MIX = 0.05
END = np.array([0x1234567890ABCDEF], U)  # the end token's hash
_ENDINGS = 1 << 16
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32


def _words(chunk):
    """rows, hashes and endings (a number of their last two bytes) of the chunk's words."""
    starts, ends = chunk.words(~SPACES)
    data = _FOLD[chunk.data]
    if not len(starts):
        return np.zeros(0, int), np.zeros(0, U), np.zeros(0, np.int64)
    tail = data[ends - 1] + np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)] << 8, 0)
    return chunk.row_of(starts), span_hashes(chunk.data, starts, ends, True), tail


def _summed(parts, limit=1_500_000):
    """Merges (keys..., n) arrays within a task; passes them on when many are held."""
    held, size = [], 0

    def merge():
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort(columns[-2::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])
        first = np.flatnonzero(new)
        return [c[first] for c in columns[:-1]] + [np.add.reduceat(columns[-1], first) if len(first) else columns[-1]]

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > limit:
            held = [merge()]
            size = len(held[0][0])
            if size > limit // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield merge()


def _count_words(batches):
    def parts():
        for chunk in chunks(batches):
            _, h, tail = _words(chunk)
            key, first, n = np.unique(h, return_index=True, return_counts=True)
            yield np.append(key, END).view(np.int64), np.append(tail[first], -1), np.append(n, chunk.n)

    for h, tail, n in _summed(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(tail.astype(np.int32)), pa.array(n)], ["h", "tail", "n"])


def _units(h: np.ndarray, tail: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Numbers of units: frequent words' places (sorted), then len(frequent) + ending."""
    if not len(frequent):
        return tail.copy()
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, at, len(frequent) + tail)


def _with_ends(chunk, rows, values, end):
    """Values by row with end after each row's, and where the ends are."""
    n = per_row(rows, chunk.n)
    at = np.arange(len(values)) + rows
    out = np.full(len(values) + chunk.n, end, values.dtype)
    out[at] = values
    return out, np.cumsum(n + 1) - 1, at


def _count_pairs(frequent):
    def run(batches):
        known = frequent.value
        end = len(known) + _ENDINGS

        def parts():
            for chunk in chunks(batches):
                rows, h, tail = _words(chunk)
                units, _, _ = _with_ends(chunk, rows, _units(h, tail, known), end)
                before = np.concatenate([[end], units[:-1]])
                key, n = np.unique(before << 20 | units, return_counts=True)
                yield key, n

        for key, n in _summed(parts()):
            yield pa.RecordBatch.from_arrays([pa.array((key >> 20).astype(np.int32)), pa.array((key & ((1 << 20) - 1)).astype(np.int32)), pa.array(n)], ["u", "v", "n"])

    return run


def exchange(size: int, u: np.ndarray, v: np.ndarray, n: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Classes of units 0 to size - 1 by exchange clustering of the pair counts; starts from frequencies dealt round."""
    total = np.bincount(v, n, size)
    order = np.argsort(-total, kind="stable")
    of = np.zeros(size, int)
    of[order] = np.minimum(np.arange(size), np.arange(size) % classes)
    pair = np.zeros((classes, classes))
    np.add.at(pair, (of[u], of[v]), n)
    by_u, by_v = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
    cut_u, cut_v = np.searchsorted(u[by_u], np.arange(size + 1)), np.searchsorted(v[by_v], np.arange(size + 1))

    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(rounds):
        moved = 0
        for w in order:
            right, left = by_u[cut_u[w] : cut_u[w + 1]], by_v[cut_v[w] : cut_v[w + 1]]
            own = n[right][v[right] == w].sum()
            right, left = right[v[right] != w], left[u[left] != w]
            r, l = np.bincount(of[v[right]], n[right], classes), np.bincount(of[u[left]], n[left], classes)
            k = of[w]
            pair[k] -= r
            pair[:, k] -= l
            pair[k, k] -= own
            # the change of sum f(pair) - f(rows) - f(columns) if w joins each class
            d = np.arange(classes)
            gain = (f(pair + r) - f(pair)).sum(1) + (f(pair + l[:, None]) - f(pair)).sum(0)
            both = pair[d, d]
            gain += f(both + r + l + own) - f(both + r) - f(both + l) + f(both)
            out, into = pair.sum(1), pair.sum(0)
            gain -= f(out + r.sum() + own + l) - f(out + l) + f(into + l.sum() + own + r) - f(into + r)
            best = int(gain.argmax())
            best = k if gain[k] >= gain[best] - 1e-9 else best
            of[w] = best
            pair[best] += r
            pair[:, best] += l
            pair[best, best] += own
            moved += best != k
        if moved <= size // 200:
            break
    return of


@dataclass
class ClassModel:
    tokens: int  # N
    distinct: int  # V
    frequent: np.ndarray  # hashes of the words that are units, sorted
    known: np.ndarray  # hashes of words whose counts and classes tasks hold, sorted
    counts: np.ndarray  # of those
    known_class: np.ndarray  # of those
    of: np.ndarray  # class of each unit; the last unit is the end
    follow: np.ndarray  # P(class | class before)
    mass: np.ndarray  # tokens of each class
    discount: np.ndarray
    unseen: np.ndarray  # what discounts took off, in tokens

    def places(self, h: np.ndarray) -> np.ndarray:
        """The places of words in known, -1 where one isn't."""
        if not len(self.known):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, -1)

    def classes(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Classes of words by hash and ending."""
        at = self.places(h)
        cls = self.of[_units(h, tail, self.frequent)]
        return np.where(at >= 0, self.known_class[at], cls) if len(self.known) else cls

    @property
    def z(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    def emitted(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Discounted counts of words of a class."""
        return np.where(c > 0, c - self.discount[cls], self.unseen[cls])


def fit(train: DataFrame, classes: int = CLASSES) -> tuple[ClassModel, DataFrame]:
    """The model, and the table (h, n) of all training words' counts."""
    spark = train.sparkSession
    train = pick(train, text="string")
    counts = stored(train.mapInArrow(_count_words, "h bigint, tail int, n bigint").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "word-counts")
    r = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = r["n"] or 0, r["v"]

    def held(most):  # words of at least 1/most of the tokens: most at the most
        rows = counts.where((F.col("n") * most >= tokens) & (F.col("tail") >= 0)).select("h", "n", "tail").toArrow()
        h, n, tail = rows.column("h").to_numpy().view(U), rows.column("n").to_numpy(), rows.column("tail").to_numpy()
        order = np.argsort(h)
        return h[order], n[order], tail[order].astype(np.int64)

    frequent, _, _ = held(UNITS)
    known, known_counts, known_tails = held(KNOWN)
    end = len(frequent) + _ENDINGS
    shared = spark.sparkContext.broadcast(frequent)
    pairs = stored(train.mapInArrow(_count_pairs(shared), "u int, v int, n bigint").groupBy("u", "v").agg(F.sum("n").alias("n")), "unit-pairs")
    own = spark.createDataFrame([(int(h), i) for i, h in enumerate(frequent.view(np.int64))], "h bigint, unit int")
    unit = F.when(F.col("tail") < 0, F.lit(end)).otherwise(F.coalesce("unit", F.col("tail") + len(frequent)))
    stats = counts.join(F.broadcast(own), "h", "left").groupBy(unit.alias("u")).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")).toArrow()
    s = {c: stats.column(c).to_numpy() for c in stats.column_names}
    # endings of less than 1/UNITS of the tokens are one unit, the end token another; both have classes of their own
    real = s["u"][(s["n"] * UNITS >= max(tokens, 1)) & (s["u"] != end)]
    rest, size = len(real), len(real) + 1
    small = np.full(end + 1, rest, np.int64)
    small[real] = np.arange(len(real))
    most = pairs.where(F.col("n") * PAIRS >= tokens).toArrow()
    u, v, n = (most.column(c).to_numpy() for c in ("u", "v", "n"))
    inside = (u != end) & (v != end)
    key, inverse = np.unique(small[u[inside]] * size + small[v[inside]], return_inverse=True)
    of_small = exchange(size, key // size, key % size, np.bincount(inverse, n[inside]) if len(key) else np.zeros(0), min(classes, size))
    of = of_small[small]
    n_classes = min(classes, size) + 1
    of[end] = n_classes - 1
    named = spark.createDataFrame([(i, int(c)) for i, c in enumerate(of)], "u int, c int")
    named = F.broadcast(named)  # at most UNITS + 65,537 rows
    both = pairs.join(named.withColumnRenamed("c", "a"), "u").join(named.select(F.col("u").alias("v"), F.col("c").alias("b")), "v")
    table = both.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    pair = np.zeros((n_classes, n_classes))
    pair[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("n").to_numpy()
    first = _follow(pair)
    by = of[s["u"]]
    mass = np.maximum(np.bincount(by, s["n"], n_classes), 1e-3)
    none = np.zeros(0)
    model = ClassModel(int(tokens), int(distinct), frequent, known, known_counts, of[_units(known, known_tails, frequent)].astype(np.int16), of, first, mass, none, none)
    model.known_class = _exchanged(train, model, n_classes)
    shared = spark.sparkContext.broadcast(model)
    table = train.mapInArrow(_count_classes(shared, n_classes), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    pair = np.zeros((n_classes, n_classes))
    pair[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("n").to_numpy()
    sums = counts.mapInArrow(_class_sums(shared, n_classes), "c int, n bigint, v bigint, n1 bigint, n2 bigint").groupBy("c").agg(*(F.sum(x).alias(x) for x in ("n", "v", "n1", "n2"))).toArrow()
    at = sums.column("c").to_numpy()
    mass, kinds, n1, n2 = (np.bincount(at, sums.column(x).to_numpy(), n_classes) for x in ("n", "v", "n1", "n2"))
    discount = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.0, 0.95)
    discount = np.where(kinds > 0, np.maximum(discount, 1e-3), 0)
    model.follow, model.discount, model.unseen, model.mass = _follow(pair), discount, np.where(mass > 0, discount * kinds, 1e-3), np.maximum(mass, 1e-3)
    return model, counts.select("h", "n")


def _follow(pair: np.ndarray) -> np.ndarray:
    """Smoothed probabilities of classes after classes from counts of pairs."""
    share = (pair.sum(0) + 0.5) / (pair.sum() + 0.5 * len(pair))
    return (pair + 5 * share) / (pair.sum(1, keepdims=True) + 5)


def _count_sides(shared, n_classes: int):
    """(at, c, n): for the place of each known word that is no unit and occurs LEAST times, the classes before it and (from n_classes) after it."""

    def run(batches):
        model = shared.value
        stays = model.counts < LEAST
        stays[model.places(model.frequent)] = True

        def parts():
            for chunk in chunks(batches):
                rows, h, tail = _words(chunk)
                uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                cls = model.of[_units(uniq, tail[first], model.frequent)]
                at = model.places(uniq)
                at[(at >= 0) & stays[at]] = -1
                seq, _, where = _with_ends(chunk, rows, cls[inverse], model.of[-1])
                mine = at[inverse] >= 0
                place, name = where[mine], at[inverse][mine]
                before = np.where(place > 0, seq[np.maximum(place - 1, 0)], model.of[-1])
                key, n = np.unique(np.concatenate([name * 2 * n_classes + before, name * 2 * n_classes + n_classes + seq[place + 1]]), return_counts=True)
                yield key, n

        for key, n in _summed(parts()):
            yield pa.RecordBatch.from_arrays([pa.array((key // (2 * n_classes)).astype(np.int32)), pa.array((key % (2 * n_classes)).astype(np.int32)), pa.array(n)], ["at", "c", "n"])

    return run


def _exchanged(train: DataFrame, model: ClassModel, n_classes: int) -> np.ndarray:
    """Classes of the known words: the likeliest for a word and its neighbours, whose classes stay; units and words that
    occur less than LEAST times keep theirs."""
    out = model.known_class.copy()
    if not len(model.known):
        return out
    shared = train.sparkSession.sparkContext.broadcast(model)
    # log likelihood of a word in class k by the classes beside it; the end has a class of its own, which no word joins
    beside = np.concatenate([np.log(model.follow), np.log(model.follow).T])[:, :-1]
    held = np.log(model.mass)[:-1]

    def best(batches):
        for batch in batches:
            sides = batch.column("sides")
            row = np.repeat(np.arange(batch.num_rows), np.diff(sides.offsets.to_numpy()))
            x = np.zeros((batch.num_rows, 2 * n_classes))
            np.add.at(x, (row, sides.flatten().field("c").to_numpy()), sides.flatten().field("n").to_numpy())
            score = x @ beside - x[:, :n_classes].sum(1, keepdims=True) * held
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(score.argmax(1).astype(np.int16))], ["at", "cls"])

    sides = train.mapInArrow(_count_sides(shared, n_classes), "at int, c int, n bigint").groupBy("at", "c").agg(F.sum("n").alias("n"))
    found = sides.groupBy("at").agg(F.collect_list(F.struct("c", "n")).alias("sides")).mapInArrow(best, "at int, cls smallint").toArrow()
    out[found.column("at").to_numpy()] = found.column("cls").to_numpy()
    return out


def _count_classes(shared, n_classes: int):
    """(a, b, n): pairs of neighbouring tokens' classes."""

    def run(batches):
        model, total = shared.value, np.zeros(n_classes * n_classes, np.int64)
        for chunk in chunks(batches):
            rows, h, tail = _words(chunk)
            uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            seq, _, _ = _with_ends(chunk, rows, model.classes(uniq, tail[first])[inverse], model.of[-1])
            before = np.concatenate([[model.of[-1]], seq[:-1]])
            total += np.bincount(before * n_classes + seq, minlength=n_classes * n_classes)
        key = np.flatnonzero(total)
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array((key // n_classes).astype(np.int32)), pa.array((key % n_classes).astype(np.int32)), pa.array(total[key])], ["a", "b", "n"])

    return run


def _class_sums(shared, n_classes: int):
    """(c, n, v, n1, n2) of each class: tokens, words, and words that occur once and twice."""

    def run(batches):
        model, total = shared.value, np.zeros((4, n_classes), np.int64)
        for batch in batches:
            h, tail, n = (batch.column(c).to_numpy() for c in ("h", "tail", "n"))
            cls = np.where(tail < 0, n_classes - 1, model.classes(h.view(U), np.maximum(tail, 0).astype(np.int64)))
            total += np.stack([np.bincount(cls, w, n_classes).astype(np.int64) for w in (n, np.ones(len(n)), n == 1, n == 2)])
        key = np.flatnonzero(total[1])
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(pa.array(t[key]) for t in total)], ["c", "n", "v", "n1", "n2"])

    return run


def _describe(model, rare: bool):
    """Sums over the words whose counts tasks hold; or, rare: other words, to be joined with their counts."""

    def run(batches):
        m: ClassModel = model.value
        end_class = m.of[-1]
        for chunk in chunks(batches):
            rows, h, tail = _words(chunk)
            uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            cls = m.classes(uniq, tail[first])
            at = m.places(uniq)
            hit = at >= 0
            count = np.where(hit, m.counts[at], 0) if len(m.known) else np.zeros(len(uniq))
            seq, last, where = _with_ends(chunk, rows, cls[inverse], end_class)
            before = np.concatenate([[end_class], seq[:-1]])
            weight = (1 - MIX) * m.follow[before, seq] / m.mass[seq]
            keys = chunk.rows.column("text_key")
            if rare:
                # each text of the chunk once, with a marker row (class -1) that joins no word
                _, once = np.unique(keys.to_numpy(), return_index=True)
                pick = np.zeros(chunk.n, bool)
                pick[once] = True
                mine = np.flatnonzero(~hit[inverse] & pick[rows])
                names = keys.take(pa.array(np.concatenate([rows[mine], once])))
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pa.array(np.concatenate([h[mine].view(np.int64), keys.to_numpy()[once]])),
                        pa.array(np.concatenate([cls[inverse][mine], np.full(len(once), -1)]).astype(np.int16)),
                        pa.array(np.concatenate([weight[where][mine], np.zeros(len(once))])),
                    ],
                    ["text_key", "h", "cls", "weight"],
                )
                continue
            c = np.zeros(len(seq))
            c[where] = count[inverse]
            c[last] = m.mass[end_class] if m.tokens else 0
            mine = np.zeros(len(seq), bool)
            mine[where] = hit[inverse]
            mine[last] = True
            row = np.zeros(len(seq), int)
            row[where], row[last] = rows, np.arange(chunk.n)
            base = (c + 0.1) / m.z
            p = weight * m.emitted(c, seq) + MIX * base
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.rows.column("doc_id"),
                    keys,
                    pa.array(per_row(rows, chunk.n) + 1),
                    pa.array(per_row(row[mine & (c > 0)], chunk.n)),
                    pa.array(per_row(row[mine], chunk.n, np.log10(base[mine]))),
                    pa.array(per_row(row[mine], chunk.n, np.log10(p[mine]))),
                ],
                ["doc_id", "text_key", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents_only(docs).select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    near = docs.mapInArrow(_describe(shared, False), "doc_id bigint, text_key bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    far = docs.mapInArrow(_describe(shared, True), "text_key bigint, h bigint, cls smallint, weight double").join(counts, "h", "left")
    c, cls = F.coalesce(F.col("n"), F.lit(0)).cast("double"), F.greatest(F.col("cls"), F.lit(0)).cast("int")
    base = (c + 0.1) / model.z

    def of(values):  # one number a class
        return F.array(*map(F.lit, values.tolist())).getItem(cls)

    p = F.col("weight") * F.when(c > 0, c - of(model.discount)).otherwise(of(model.unseen)) + MIX * base
    word = F.col("cls") >= 0
    far = far.groupBy("text_key").agg(
        F.sum(F.when(word & (c > 0), 1).otherwise(0)).alias("k"),
        F.sum(F.when(word, F.log10(base)).otherwise(0.0)).alias("b"),
        F.sum(F.when(word, F.log10(p)).otherwise(0.0)).alias("s"),
        F.sum(F.when(word, 0).otherwise(1)).alias("times"),
    )
    every = near.join(far, "text_key", "left")
    share = [F.coalesce(F.col(x) / F.col("times"), F.lit(0.0)) for x in ("k", "b", "s")]
    return every.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.round(share[0]).cast("bigint")).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + share[1]).alias("base_score"), (F.col("score") + share[2]).alias("score"),
    )
