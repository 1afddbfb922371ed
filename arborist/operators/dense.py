"""Dense retrieval by dot products of unit vectors, and fusion of rankings."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, normalised
from ..sources.layout import stored
from .lexical import ranked

#: A stated query set is broadcast up to this many rows; beyond it, queries go in blocks of as many.
QUERY_BLOCK = 10_000
#: A group of top_within() is up to so many queries and items, and about so many pairs; it compares a few queries with AT_ONCE items at a time.
GROUP_QUERIES, GROUP_ITEMS, GROUP_PAIRS, AT_ONCE = 32_768, 262_144, 1 << 32, 2048
LEAST_PAIRS = 1 << 25  # so many pairs aren't worth a group of their own: some 0.3 s, and a group's first pairs cost most
QUERIES_AT_ONCE = 1024


def scores(queries: DataFrame, items: DataFrame, item: str = "doc_id") -> DataFrame:
    """(query_id, item, score): every query against every item, vectors normalised once a row.

    The queries (query_id, embedding) are a stated set against all rows, not a join of the table with itself.  Their
    number is checked: up to QUERY_BLOCK they are one broadcast, else blocks of them are, one after another.
    """
    asked = queries.select("query_id", normalised(F.col("embedding")).alias("_q"))
    stored = items.select(item, normalised(F.col("embedding")).alias("_d"))
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK) or 1
    out = None
    for k in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        part = stored.join(F.broadcast(block)).select("query_id", item, dot(F.col("_q"), F.col("_d")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def pair_scores(pairs: DataFrame, queries: DataFrame, items: DataFrame, item: str = "doc_id") -> DataFrame:
    """(query_id, item, score) of given pairs alone: they meet their two vectors by joins, up to QUERY_BLOCK queries without moving the items'."""
    rows = pairs.select("query_id", item).distinct()
    rows = rows.join(items.select(item, normalised(F.col("embedding")).alias("_d")), item)
    asked = queries.select("query_id", normalised(F.col("embedding")).alias("_q"))
    asked = F.broadcast(asked) if queries.count() <= QUERY_BLOCK else asked
    return rows.join(asked, "query_id").select("query_id", item, dot(F.col("_q"), F.col("_d")).alias("score"))


def doubt(dim: int) -> float:
    """Twice what a product of two unit vectors may be off in single precision, and more; pairs this near are computed again."""
    return (dim + 8) * 2.0**-23


def _unit(column: pa.Array, dim: int, unlike: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as normalised() makes them, padded to dim, and their lengths; `unlike` where a vector or a number in it is null."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten()
    rows = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits, missing = at < dim, flat.is_null().to_numpy(zero_copy_only=False)
    v = np.zeros((len(column), dim))
    v[rows[fits], at[fits]] = np.where(missing, 0.0, flat.to_numpy(zero_copy_only=False))[fits]
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), unlike, sizes)
    lengths[rows[missing]] = unlike
    return v / np.maximum(np.sqrt(_dots(v, v)), 1e-12)[:, None], lengths


@dataclass
class _Plain:
    """Vectors of one length without nulls, NaN or infinities: their places in the group, numbers, lengths, and unit vectors in single precision."""

    rows: np.ndarray
    raw: np.ndarray
    norm: np.ndarray
    unit: np.ndarray

    def slice(self, *at) -> _Plain:
        at = at[0] if len(at) == 1 else slice(*at)
        return _Plain(self.rows[at], self.raw[at], self.norm[at], self.unit[at])

    def exact(self, at: np.ndarray) -> np.ndarray:
        return self.raw[at].astype(float) / self.norm[at][:, None]


def _plain(column: pa.Array, dim: int) -> _Plain:
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    raw = (column if len(rows) == len(column) else column.take(pa.array(rows))).flatten()
    bad = raw.is_null().to_numpy(zero_copy_only=False) if raw.null_count else None
    raw = raw.to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    good = np.isfinite(raw).all(1) if bad is None else np.isfinite(raw).all(1) & ~bad.reshape(raw.shape).any(1)
    if not good.all():
        rows, raw = rows[good], raw[good]
    norm, unit = np.empty(len(rows)), np.empty(raw.shape, np.float32)
    for k in range(0, len(rows), _FEW):
        x = raw[k : k + _FEW].astype(float)
        norm[k : k + _FEW] = np.maximum(np.sqrt(_dots(x, x)), 1e-12)
        unit[k : k + _FEW] = x / norm[k : k + _FEW, None]
    return _Plain(rows, raw, norm, unit)


def _copies_beyond(items: _Plain, places: np.ndarray, limit: int) -> np.ndarray:
    """Which items come after `limit` others with the same numbers; as copies score the same, none of them is among a query's first."""
    late = np.zeros(len(items.rows), bool)
    if len(late) <= limit:
        return late
    words = np.ascontiguousarray(items.raw).view(np.uint32)
    h = np.zeros(len(late), np.uint64)
    for j in range(words.shape[1]):  # finds what may be equal; bytes decide
        h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    edges = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] ^ np.uint64(1), append=h[order[-1]] ^ np.uint64(1)))
    for a, b in zip(edges[:-1][np.diff(edges) > limit], edges[1:][np.diff(edges) > limit]):
        same = order[a:b]
        same = same[(words[same] == words[same[0]]).all(1)]
        late[same[np.argsort(places[items.rows[same]], kind="stable")[limit:]]] = True
    return late


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of dot(), so that scores are the same to the last bit."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s = s + a[:, j] * b[:, j]
    return s


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores times 10^9, rounded half up in decimals as Spark rounds; NaN above all, and null (-inf) below."""
    with np.errstate(invalid="ignore"):
        x = np.abs(scores) * 1e9
        r = np.floor(x + 0.5)
        for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-5):
            r[i] = float(Decimal(repr(float(np.abs(scores[i])))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(scores), np.inf, np.where(scores < 0, -r, r))


def _first(q, i, s, places, limit):
    """Of pairs (query, item, score) each query's first `limit` by rounded score, then by the item's place."""
    order = np.lexsort((places[i], -_rounded(s), q))
    q, i, s = q[order], i[order], s[order]
    start = np.searchsorted(q, q)
    keep = np.arange(len(q)) - start < limit
    return q[keep], i[keep], s[keep]


def _masked(a, na, b, nb, places, limit, at_once):
    """(query, item, score) of each query's first, for vectors of any kind; those of unlike lengths score null (-inf)."""
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    least = np.full(len(a), -np.inf)  # a query's limit-th score so far; lower ones aren't among its first
    best = np.empty(0, int), np.empty(0, int), np.empty(0)
    for at in range(0, len(b), at_once):
        end = min(at + at_once, len(b))
        with np.errstate(invalid="ignore"):
            near = a32 @ b32[at:end].T
            unlike = na[:, None] != nb[None, at:end]
            near[unlike] = -np.inf
            near[np.isnan(near)] = np.inf
            # the limit-th of this block bounds what its others need, up to what single precision can be off
            bar = least
            if end - at > limit:
                some = np.partition(near, end - at - limit, axis=1)[:, end - at - limit]
                bar = np.maximum(bar, some)
            qs, its = np.nonzero(near >= (bar - doubt(a.shape[1]))[:, None])
        for k in range(0, len(qs), 1 << 17):
            q, i = qs[k : k + (1 << 17)], its[k : k + (1 << 17)] + at
            s = np.where(na[q] == nb[i], _dots(a[q], b[i]), -np.inf)
            best = _first(*(np.concatenate(x) for x in zip(best, (q, i, s))), places, limit)
        full = np.bincount(best[0], minlength=len(a)) >= limit
        last = np.searchsorted(best[0], np.flatnonzero(full), "right") - 1
        least[full] = np.where(np.isnan(best[2][last]), np.inf, best[2][last])
    return best


# A pair that may be among the first is a number: 12 bits of its query, 32 of its score (descending), 20 of its item.
def _packed(q: np.ndarray, s: np.ndarray, i: np.ndarray) -> np.ndarray:
    bits = (s + np.float32(0.0)).view(np.uint32)  # -0.0 is 0.0
    down = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF)).astype(np.uint64)
    return (q.astype(np.uint64) << np.uint64(52)) | (down << np.uint64(20)) | i.astype(np.uint64)


def _score_of(pairs: np.ndarray) -> np.ndarray:
    down = (pairs >> np.uint64(20)).astype(np.uint32)
    return np.where(down >> 31, down, ~down & np.uint32(0x7FFFFFFF)).astype(np.uint32).view(np.float32)


def _exact(queries: _Plain, items: _Plain, q: np.ndarray, i: np.ndarray) -> np.ndarray:
    out = np.empty(len(q))
    for k in range(0, len(q), _FEW):
        out[k : k + _FEW] = _dots(queries.exact(q[k : k + _FEW]), items.exact(i[k : k + _FEW]))
    return out


def _of_some(queries: _Plain, items: _Plain, first: int, end: int, places: np.ndarray, limit: int, at_once: int):
    """(query, item, score) of the first of queries first to end, by numbers in _Plain; most pairs are a product and a comparison."""
    n, off = end - first, np.float32(doubt(items.raw.shape[1]))
    a, least = queries.unit[first:end], np.full(end - first, -np.inf, np.float32)
    held, new, waiting = np.empty(0, np.uint64), [], 0

    def numbers(pairs):
        return (pairs >> np.uint64(52)).astype(int) + first, (pairs & np.uint64((1 << 20) - 1)).astype(int)

    def first_exact(pairs):
        q, i = numbers(pairs)
        return _first(q, i, _exact(queries, items, q, i), places, limit)

    for at in range(0, len(items.rows), at_once):
        near = a @ items.unit[at : at + at_once].T
        width = near.shape[1]
        if not at and width > limit:
            least = np.partition(near, width - limit, axis=1)[:, width - limit]
        hit = near >= (least - off)[:, None]
        if width % 8:
            place = np.flatnonzero(hit)
        else:  # eight at once
            eight = np.flatnonzero(hit.view(np.uint64))
            place = (eight[:, None] * 8 + np.arange(8))[hit.reshape(-1, 8)[eight]]
        if not len(place):
            continue
        q, i = np.divmod(place, width)
        new.append(_packed(q, near.ravel()[place], i + at))
        waiting += len(place)
        if 4 * waiting < limit * n:
            continue
        held, new, waiting = np.sort(np.concatenate([held, *new])), [], 0
        start = np.searchsorted(held, np.arange(n + 1, dtype=np.uint64) << np.uint64(52))
        full = np.flatnonzero(np.diff(start) >= limit)
        least[full] = _score_of(held[start[full] + limit - 1])
        q = (held >> np.uint64(52)).astype(int)
        held = held[_score_of(held) >= (least - off)[q]]
        if len(held) > 2 * limit * n + _MANY:  # so many are nearly equal
            q, i, s = first_exact(held)
            held = _packed(q - first, np.einsum("ij,ij->i", queries.unit[q], items.unit[i]), i)
    return first_exact(np.concatenate([held, *new]))


_FEW, _MANY, _NUMBERS = 4096, 1 << 20, 1 << 20


def _nearest(limit: int, asked: list[str], item: str, at_once: int = AT_ONCE, some: int = QUERIES_AT_ONCE):
    """Queries (asked, _v) and items (item, _v) of a group to (asked, item, score)."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        held = [pa.concat_arrays(t["_v"].chunks) if t.num_rows else pa.array([], t["_v"].type) for t in (queries, items)]
        places = np.empty(items.num_rows, int)
        places[pc.sort_indices(items, [(item, "ascending")], null_placement="at_start").to_numpy()] = np.arange(items.num_rows)
        lengths = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in held]
        dim = int(np.bincount(lengths[0][lengths[0] > 0]).argmax()) if lengths[0].any() else 0
        found = []
        odd = [np.arange(t.num_rows) for t in (queries, items)]
        if dim:
            q, d = (_plain(c, dim) for c in held)
            odd = [np.setdiff1d(o, p.rows, True) for o, p in zip(odd, (q, d))]
            late = _copies_beyond(d, places, limit)
            if late.any():
                d = d.slice(~late)
            for part in [d.slice(k, k + _NUMBERS) for k in range(0, len(d.rows), _NUMBERS)]:
                for k in range(0, len(q.rows), some):
                    x = _of_some(q, part, k, min(k + some, len(q.rows)), places[part.rows], limit, at_once)
                    found.append((q.rows[x[0]], part.rows[x[1]], x[2]))
        # vectors of another kind: odd queries with all items, the others with odd items
        rest = [(odd[0], np.arange(items.num_rows))]
        if dim:
            rest.append((q.rows, odd[1]))
        wide = max((int(n.max()) for n in lengths if len(n)), default=0)
        for rows, others in rest:
            if not len(rows) or not len(others):
                continue
            b, nb = _unit(held[1].take(pa.array(others)), wide, -2)
            for k in range(0, len(rows), some):
                few = rows[k : k + some]
                a, na = _unit(held[0].take(pa.array(few)), wide, -1)
                x = _masked(a, na, b, nb, places[others], limit, at_once)
                found.append((few[x[0]], others[x[1]], x[2]))
        q, i, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        if len(odd[0]) + len(odd[1]) or items.num_rows > _NUMBERS:
            q, i, s = _first(q, i, s, places, limit)
        score = pa.array(s, pa.float64(), mask=np.isneginf(s))
        return pa.table([*(queries[c].take(pa.array(q)) for c in asked), items[item].take(pa.array(i)), score], names=[*asked, item, "score"])

    return run


def top_within(queries: DataFrame, items: DataFrame, limit: int, within: list[str], item: str = "doc_id") -> DataFrame:
    """(query_id, *within, item, score, rank): the limit best items of each query (query_id, embedding) among those that have its `within`.

    Pairs aren't rows: queries and items are dealt to groups of bounded size, each compares its queries with its items as a
    product of matrices, in blocks, and gives its first of each query; these are ranked again.  A pair costs its product and one comparison with
    what its query's first reach so far; what is in doubt in single precision is computed as dot() does, so results are
    exact, ties by id.  Of items with equal vectors a group looks at the first `limit`.  Vectors of unlike lengths or with nulls have a null score,
    which comes last.  Work grows with the pairs, what is shuffled with the tables' sizes times the number of groups across;
    these are as few as bounds and cores allow, and more of that side which costs less.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", *within, F.col("embedding").alias("_v"))
    d = items.select(*within, item, F.col("embedding").alias("_v"))
    if within:
        nq, nd = (t.groupBy(*within).agg(F.count("*").alias(n)) for t, n in ((q, "_nq"), (d, "_nd")))
        blocks = stored(nq.join(nd, within))  # counted once for the sums below and the deal
    else:
        nq, nd = q.count(), d.count()
        blocks = spark.range(1 if nq and nd else 0).select(*(F.lit(max(n, 1)).cast("bigint").alias(c) for n, c in ((nq, "_nq"), (nd, "_nd"))))
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = blocks.agg(F.sum(F.col("_nq").cast("double") * F.col("_nd"))).first()[0] or 0.0
    each = min(GROUP_PAIRS, max(LEAST_PAIRS, pairs / cores))
    number = F.greatest(F.lit(1.0), F.col("_nq").cast("double") * F.col("_nd") / each)
    # an item moves as often as there are groups of queries; a query, and its first, as there are groups of items
    across = F.ceil(F.greatest(F.col("_nq") / GROUP_QUERIES, F.least(number, F.sqrt(number * F.col("_nq") * (1 + limit / 8) / F.col("_nd")))))
    blocks = blocks.select(*within, "_nq", "_nd", F.least(across, F.col("_nq")).cast("int").alias("_qs"), number.alias("_n"))
    along = F.ceil(F.greatest(F.col("_nd") / GROUP_ITEMS, F.col("_n") / F.col("_qs")))
    blocks = blocks.select(*within, "_qs", F.least(along, F.col("_nd")).cast("int").alias("_ds"))
    number = blocks.agg(F.sum(F.col("_qs").cast("bigint") * F.col("_ds"))).first()[0] or 1
    met = lambda t: t.join(blocks, within) if within else t.join(F.broadcast(blocks))  # noqa: E731 - without a key it is one row
    one, every = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = met(q).select("query_id", *within, "_v", one("query_id", "_qs").alias("_q"), every("_ds").alias("_d"))
    d = met(d).select(*within, item, "_v", every("_qs").alias("_q"), one(item, "_ds").alias("_d"))
    keys = [*within, "_q", "_d"]
    parts = 3 * number if number < cores else 2 * number
    q, d = (t.repartition(parts, *keys) for t in (q, d))
    asked = ["query_id", *within]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*queries.select(*asked).schema, items.schema[item]])
    found = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(_nearest(limit, asked, item, AT_ONCE), f"{kinds}, score double")
    return ranked(found, asked, "score", item, limit)


def top(queries: DataFrame, items: DataFrame, limit: int, item: str = "doc_id", exclude: DataFrame | None = None) -> DataFrame:
    """The limit best items of each query by score, ties by id; exclude (query_id, item) are left out first."""
    more = 0
    if exclude is not None:
        exclude = exclude.select("query_id", item).distinct()
        more = exclude.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = top_within(queries, items, limit + more, [], item).drop("rank")
    if exclude is not None:
        rows = rows.join(exclude, ["query_id", item], "left_anti")
    return ranked(rows, "query_id", "score", item, limit)


def zscore(value: str, by: str) -> Column:
    """Population z-score within by; 0 if the spread is at most 1e-9."""
    w = Window.partitionBy(by)
    spread = F.stddev_pop(value).over(w)
    return F.when(spread > 1e-9, (F.col(value) - F.avg(value).over(w)) / spread).otherwise(F.lit(0.0))


def best_per_item(rows: DataFrame, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """One row for each item: its largest score."""
    return rows.groupBy(by, item).agg(F.max(score).alias(score))


def augmented(run: DataFrame, dense: DataFrame) -> DataFrame:
    """run, and with score 0 what dense has more."""
    more = dense.select("query_id", "doc_id").join(run.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return run.select("query_id", "doc_id", "score").unionByName(more.withColumn("score", F.lit(0.0)))


def blended(run: DataFrame, similarity: DataFrame, alpha: float) -> DataFrame:
    """(query_id, doc_id, score): alpha * similarity + (1 - alpha) * z-score of the run's score."""
    z = run.withColumn("z", zscore("score", "query_id")).select("query_id", "doc_id", "z")
    rows = z.join(similarity.select("query_id", "doc_id", F.col("score").alias("s")), ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", (alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.col("z")).alias("score"))


def reciprocal_ranks(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over two ranked runs."""
    both = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"], "full")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return both.select("query_id", "doc_id", (part("ra") + part("rb")).alias("score"))
