"""Near-duplicates by BagMinHash signatures of word-shingle multisets, banding, and exact checks of multiset overlap.

A document's bag holds its shingles of five words (A-Z folded) with their numbers of occurrences; a text of one to four
words is one shingle of them all.  Two documents are linked if the weighted Jaccard similarity of their bags is at least
`threshold` (0.8); classes are the connected components of verified links.

Signatures: each shingle x carries independent Poisson processes over (time, weight).  The weight axis is cut into
[0,1), [1,2), [2,4), [4,8) ...; an interval of length n has points at rate n, and a point counts if the dyadic position
that its hash gives it within its interval lies below the shingle's weight.  Each point falls into one of REGISTERS at
random, a register keeps its earliest point, and as points depend on the shingle, interval and number alone, two bags
agree in a register with just their weighted Jaccard similarity as probability.  Only points before a time by which all
registers are full are made (the time is raised for the few texts where one isn't).  A band joins ROWS registers; bands
are drawn from all registers.  Of pairs with similarity 0.8 three in 100,000 meet in no band, and of 0.85 one in nine
million, as bands are a matter of chance; whatever meets in a bucket is compared exactly, without caps.

Bags are the rows of all steps, each with a number of its own, so texts with equal bags are compared once, and texts that
share a doc_id are apart.  Two rounds of comparisons:

1. Every bucket's bags are compared with one of them, the pivot: the bag that shares buckets with most others, in groups of
   copies mostly the text that the others were made from.  The links make classes.
2. In buckets that still have several classes, the members outside the largest class are compared with all members of other
   classes.  A pair is compared in the first of its common bands alone, and only if enough registers agree (of pairs at the
   threshold one in a thousand million doesn't have so many).  Large buckets are dealt in blocks of OUTSIDERS by MEMBERS, so
   no task holds a bucket and no pairs are emitted; a member's text is sent once a block.

The work of round 2 is a bucket's members times those outside its largest class, some 230 ns a pair.  Joins by band or by
bag are sort-merge joins that adaptive execution splits where one side has a hot key (one text may be a third of all rows;
the other side has one row a key); what is aggregated by key is combined before it is shuffled.  Intermediate tables are
written to the shared folder, and deleted as soon as they aren't needed.

Cases: null and wordless texts have no bag; each is a class of its own.  Repeated rows are copies of one document: all are
kept or none.  A class_id is the least doc_id of the class, null only if all its ids are null; rows with a null id are kept
only in such classes.  An empty table gives an empty result.  Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import Scratch, documents_only
from .words import SMALL_CHUNK, SPACES, U, chunks, let_go, mix, per_row, span_hashes

SHINGLE = 5
REGISTERS, BANDS, ROWS = 256, 60, 7
SHARE = 200  # members that are compared with a pivot in one group
OUTSIDERS, MEMBERS = 256, 2048
_GOLD = U(0x9E3779B97F4A7C15)


def bags(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, weight), sorted by row and hash, each shingle of a row once."""
    starts, ends = chunk.words(~SPACES)
    rows = chunk.row_of(starts)
    h = span_hashes(chunk.data, starts, ends, True)
    n_words = per_row(rows, chunk.n)
    m = max(0, len(h) - SHINGLE + 1)
    key = np.zeros(m, U)
    for k in range(SHINGLE):
        key = mix(key * _GOLD + h[k : k + m])
    whole = rows[:m] == rows[SHINGLE - 1 :][:m]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    first = np.searchsorted(rows, short)
    one = np.zeros(len(short), U)
    for k in range(SHINGLE - 1):
        has = n_words[short] > k
        one[has] = mix(one[has] * _GOLD + h[first[has] + k])
    row = np.concatenate([rows[:m][whole], short])
    key = np.concatenate([key[whole], mix(one ^ U(0x5851F42D4C957F2D))])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(key)))


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """BagMinHash: n rows of 64-bit register values; rows without elements are 0."""
    out = np.zeros((n, registers), U)
    total = per_row(row, n, weight)
    todo, slack = total > 0, 3.0
    while todo.any():
        until = registers / np.maximum(total, 1e-9) * (np.log(registers) + slack)
        best = np.full(n * registers, np.inf)
        mark = np.zeros(n * registers, U)
        pick = todo[row]
        e_row, e_key, e_weight = row[pick], key[pick], weight[pick]
        level, at = 0, np.arange(len(e_row))
        while len(at):
            low, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            r, w = e_row[at], e_weight[at]
            seed = mix(e_key[at] + U((level + 1) * 0xD1342543DE82EF95 % 2**64))
            t, end = np.zeros(len(at)), until[r]
            i = 0
            while len(r):
                i += 1
                x = mix(seed + U(i * int(_GOLD) % 2**64))
                t = t - np.log(((x >> U(11)).astype(float) + 1) / 2.0**53) / size
                live = t <= end
                r, w, seed, t, end, x = r[live], w[live], seed[live], t[live], end[live], x[live]
                x = mix(x + _GOLD)
                y = low + (x >> U(20)).astype(np.int64) % size
                inside = y < w
                cell = (r * registers + (mix(x ^ U(0xA0761D6478BD642F)) % U(registers)).astype(np.int64))[inside]
                np.minimum.at(best, cell, t[inside])
                won = best[cell] == t[inside]
                mark[cell[won]] = x[inside][won]
            level += 1
            at = at[e_weight[at] > (1 << (level - 1))]
        full = todo & ~np.isinf(best.reshape(n, registers)).any(1)
        out[full] = mark.reshape(n, registers)[full]
        todo, slack = todo & ~full, slack + 6
    return out


def weighted_jaccard(pivot: tuple[np.ndarray, np.ndarray], row, key, weight, n: int) -> np.ndarray:
    """Similarity of each row's bag to the pivot's (sorted hashes, weights)."""
    hashes, counts = pivot
    at = np.minimum(np.searchsorted(hashes, key), max(0, len(hashes) - 1))
    both = np.where(hashes[at] == key, np.minimum(counts[at], weight), 0) if len(hashes) else np.zeros(len(key))
    shared = per_row(row, n, both)
    return shared / np.maximum(per_row(row, n, weight) + counts.sum() - shared, 1e-9)


def band_registers(registers: int, bands: int, rows: int) -> np.ndarray:
    """The registers of each band: `rows` different ones."""
    deal = np.random.RandomState(11)
    return np.stack([deal.permutation(registers)[:rows] for _ in range(bands)])


def keys_of(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's bag."""
    a, b = np.zeros(n, U), np.zeros(n, U)
    np.add.at(a, row, mix(key) * weight.astype(U))
    np.add.at(b, row, mix(key ^ _GOLD) * weight.astype(U))
    return a.view(np.int64), b.view(np.int64)


def _describe(registers: int, bands: int, rows: int):
    def run(batches):
        let_go()
        of_band = band_registers(registers, bands, rows)
        for chunk in chunks(batches, SMALL_CHUNK):
            row, key, weight = bags(chunk)
            n = chunk.n
            a, b = keys_of(row, key, weight, n)
            some = per_row(row, n) > 0
            _, first, inverse = np.unique(mix(a.view(U)) ^ b.view(U), return_index=True, return_inverse=True)
            pick = np.zeros(n, bool)
            pick[first] = True
            keep = pick[row]
            sig = signatures(row[keep], key[keep], weight[keep], n, registers)[first[inverse]]
            band = np.zeros((n, bands), U)
            for k in range(rows):
                band = mix(band * _GOLD + sig[:, of_band[:, k]])
            band = mix(band + np.arange(1, bands + 1, dtype=U)).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(band.ravel()))
            marks = pa.Array.from_buffers(pa.binary(registers), n, [None, pa.py_buffer(np.ascontiguousarray(sig.astype(np.uint8)))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), chunk.rows.column("digest"), pa.array(some), pa.array(a), pa.array(b), lists, marks], ["doc_id", "digest", "some", "key_a", "key_b", "bands", "marks"])

    return run


def digested(docs: DataFrame) -> DataFrame:
    """docs with a 16-byte digest of each text."""
    return docs.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _first_of_each(batches):
    """The first of neighbouring rows of one bag: a repeated row is there several times."""
    last = None
    for batch in batches:
        bag = batch.column("bag").to_numpy()
        new = np.ones(len(bag), bool)
        new[1:] = bag[1:] != bag[:-1]
        if len(bag):
            new[0], last = bag[0] != last, bag[-1]
        yield batch.filter(pa.array(new))


def texts_of(docs: DataFrame, bags: DataFrame) -> DataFrame:
    """bag and text of bags (bag, id, digest), by a join on id and digest, which repeated rows alone have in common."""
    rows = digested(docs).withColumnRenamed("digest", "of")
    found = bags.join(rows, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("doc_id"))).select("bag", "text")
    return found.mapInArrow(_first_of_each, "bag bigint, text string")


def _verify(threshold: float, bags):
    """Rows (pivot, share, role, bag, text) sorted so that a share's pivot (role 0) comes before its members."""

    def run(batches):
        pivot, name = None, None
        for chunk in chunks(batches):
            row, key, weight = bags(chunk)
            cut = np.searchsorted(row, np.arange(chunk.n + 1))
            names = list(zip(chunk.rows.column("pivot").to_pylist(), chunk.rows.column("share").to_pylist()))
            role, bag = chunk.rows.column("role").to_numpy(), chunk.rows.column("bag").to_numpy()
            at, out = 0, []
            while at < chunk.n:
                end = at + 1
                while end < chunk.n and names[end] == names[at] and role[end]:
                    end += 1
                if not role[at]:
                    pivot, name = (key[cut[at] : cut[at + 1]], weight[cut[at] : cut[at + 1]]), names[at]
                assert name == names[at], "a share's pivot comes first"
                s = slice(cut[at], cut[end])
                like = weighted_jaccard(pivot, row[s] - at, key[s], weight[s], end - at)
                hit = np.flatnonzero((like >= threshold - 1e-12) & (role[at:end] == 1))
                out += [(bag[at + i], names[at][0], like[i]) for i in hit]
                at = end
            a, b, like = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], ["a", "b", "similarity"])

    return run


def verified(texts: DataFrame, pairs: DataFrame, threshold: float, bags=bags) -> DataFrame:
    """Those pairs (a, b; distinct) of texts (bag, text) that are similar enough, with their similarity; bags: what is compared of a chunk."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    members = pairs.join(shares, "b").select(F.col("a").alias("bag"), F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"))
    pivots = shares.select(F.col("b").alias("bag"), F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"))
    sent = texts.join(members.unionByName(pivots), "bag").select("pivot", "share", "role", "bag", "text")
    sent = sent.repartition(F.col("pivot"), F.col("share")).sortWithinPartitions("pivot", "share", "role")
    return sent.mapInArrow(_verify(threshold, bags), "a bigint, b bigint, similarity double")


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of a column of lists or binaries of one length."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(len(column), -1)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _between_classes(threshold: float, registers: int):
    """Rows (band, i, j, role, bag, label, outsider, bands, marks, text), sorted: of a block, the outsiders (role 0) come
    before the members (role 1)."""
    least = registers * (threshold - 6 * np.sqrt(threshold * (1 - threshold) / registers))

    def run(batches):
        name, held = None, []
        for chunk in chunks(batches):
            rows = chunk.rows
            row, key, weight = bags(chunk)
            cut, total = np.searchsorted(row, np.arange(chunk.n + 1)), per_row(row, chunk.n, weight)
            band, bag, label = (rows.column(c).to_numpy() for c in ("band", "bag", "label"))
            role, outside = rows.column("role").to_numpy(), rows.column("outsider").to_numpy(zero_copy_only=False)
            names = np.stack([band, rows.column("i").to_numpy(), rows.column("j").to_numpy(), role], 1)
            bands, marks = _matrix(rows.column("bands"), None), _matrix(rows.column("marks"), np.uint8)
            edges = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(1)))
            out = []
            for at, end in zip(edges.tolist(), np.append(edges[1:], chunk.n).tolist()):
                if name != names[at, :3].tolist():
                    name, held = names[at, :3].tolist(), []
                if not role[at]:
                    held += [(bag[k], label[k], bands[k], marks[k], total[k], key[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]]) for k in range(at, end)]
                    continue
                for x_bag, x_label, x_bands, x_marks, x_total, x_key, x_weight in held:
                    near = (label[at:end] != x_label) & ~(outside[at:end] & (bag[at:end] <= x_bag))
                    near &= np.minimum(total[at:end], x_total) >= (threshold - 1e-9) * np.maximum(total[at:end], x_total)
                    near = at + np.flatnonzero(near)
                    near = near[(marks[near] == x_marks).sum(1) >= least]
                    if len(near):
                        common = bands[near] == x_bands
                        near = near[x_bands[common.argmax(1)] == band[at]]
                    if not len(near):
                        continue
                    n = cut[near + 1] - cut[near]
                    entries = np.repeat(cut[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    like = weighted_jaccard((x_key, x_weight), np.repeat(np.arange(len(near)), n), key[entries], weight[entries], len(near))
                    hit = np.flatnonzero(like >= threshold - 1e-12)
                    _, once = np.unique(label[near[hit]], return_index=True)  # a link to each class is enough
                    out += [(bag[near[k]], x_bag, like[k]) for k in hit[once]]
            a, b, like = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], ["a", "b", "similarity"])

    return run


def between_classes(texts: DataFrame, shared: DataFrame, labels: DataFrame, threshold: float, registers: int) -> DataFrame:
    """Links between bags of different classes that meet in a bucket; one for each member and class, at least."""
    known = shared.select("bag", "band").join(labels.withColumnRenamed("doc", "bag"), "bag", "left").withColumn("label", F.coalesce("label", "bag"))
    classes = known.groupBy("band", "label").agg(F.count("*").alias("n"))
    buckets = classes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n")).where(F.col("most.n") < F.col("n"))
    blocks = buckets.select("band", F.col("most.label").alias("largest"), F.ceil((F.col("n") - F.col("most.n")) / OUTSIDERS).cast("int").alias("i_n"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("j_n"))
    rows = known.join(blocks, "band").withColumn("outsider", F.col("label") != F.col("largest"))
    block = F.xxhash64("bag")
    outsiders = rows.where("outsider").select("bag", "band", "label", "outsider", F.lit(0).alias("role"), F.pmod(block, F.col("i_n")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_n") - 1)).alias("j"))
    members = rows.select("bag", "band", "label", "outsider", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("i_n") - 1)).alias("i"), F.pmod(block, F.col("j_n")).cast("int").alias("j"))
    sent = texts.join(outsiders.unionByName(members), "bag").select("band", "i", "j", "role", "bag", "label", "outsider", "bands", "marks", "text")
    sent = sent.repartition(F.col("band"), F.col("i"), F.col("j")).sortWithinPartitions("band", "i", "j", "role")
    return sent.mapInArrow(_between_classes(threshold, registers), "a bigint, b bigint, similarity double")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, label) of every end of edges (a, b): the least doc of its component; labels are halved in distance each round."""
    both = scratch.store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.store(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("near"))
        step = scratch.store(labels.join(near, "doc").select("doc", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step")
        # a label's own label is at most as large
        over = step.select(F.col("doc").alias("label"), F.col("label").alias("over"))
        new = scratch.store(step.join(over, "label", "left").select("doc", "old", F.least("label", F.coalesce("over", "label")).alias("label")), "labels")
        scratch.drop(labels, step)
        if new.where(F.col("old") != F.col("label")).isEmpty():
            scratch.drop(both)
            return new.select("doc", "label")
        labels = new


def _classified(docs: DataFrame, threshold: float, registers: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """Rows with the keys of their bags, and key_a, key_b, label and class_id of all bags."""
    docs = documents_only(docs)
    scratch = Scratch(docs.sparkSession, "near_dedup")
    described = digested(docs).mapInArrow(_describe(registers, bands, rows), "doc_id bigint, digest binary, some boolean, key_a bigint, key_b bigint, bands array<bigint>, marks binary")
    described = scratch.store(described.withColumn("bag", F.monotonically_increasing_id()), "described")
    full = described.where("some")
    least = full.groupBy("key_a", "key_b").agg(F.min("bag").alias("bag"), F.min("doc_id").alias("least_id"))
    same = scratch.store(full.join(least.select("bag", "least_id"), "bag"), "bags")
    members = same.select("bag", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.store(members.join(sizes, "band"), "shared")
    reach = shared.groupBy("bag").agg(F.sum("n").alias("reach"))
    candidates = same.join(reach.select("bag"), "bag", "left_semi").select("bag", F.col("doc_id").alias("id"), "digest")
    texts = scratch.store(texts_of(docs, candidates), "texts")
    pivots = shared.join(reach, "bag").groupBy("band").agg(F.max(F.struct("reach", (-F.col("bag")).alias("bag"))).alias("pivot")).select("band", (-F.col("pivot.bag")).alias("b"))
    pairs = scratch.store(shared.join(pivots, "band").where(F.col("bag") != F.col("b")).select(F.col("bag").alias("a"), "b").distinct(), "pairs")
    links = scratch.store(verified(texts, pairs, threshold), "links")
    labels = components(links, scratch)
    described_texts = texts.join(same.select("bag", "bands", "marks"), "bag")
    further = scratch.store(between_classes(described_texts, shared, labels, threshold, registers), "further")
    known = labels.select(F.col("doc").alias("a"), F.col("label").alias("b")).where("a <> b")
    labels = components(known.unionByName(further.select("a", "b")), scratch)
    labelled = same.select("bag", "key_a", "key_b", "least_id").join(labels.withColumnRenamed("doc", "bag"), "bag", "left").withColumn("label", F.coalesce("label", "bag"))
    least = labelled.groupBy("label").agg(F.min("least_id").alias("class_id"))
    classes = scratch.store(labelled.join(least, "label").select("key_a", "key_b", "label", "class_id"), "classes")
    return described, classes, scratch


def near_duplicates(docs: DataFrame, threshold: float = 0.8, registers: int = REGISTERS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept (doc_id is class_id) for every document."""
    described, classes, scratch = _classified(docs, threshold, registers, bands, rows)
    out = described.where("some").select("doc_id", "key_a", "key_b").join(classes, ["key_a", "key_b"]).select("doc_id", "class_id")
    out = scratch.store(out.unionByName(described.where("not some").select("doc_id", F.col("doc_id").alias("class_id"))), "result")
    scratch.keep_only(out)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def text_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """digest and label: a row for the digest of each text that has words (see digested()); near-duplicates have one label."""
    described, classes, scratch = _classified(docs, threshold, REGISTERS, BANDS, ROWS)
    texts = described.where("some").groupBy("digest").agg(F.min("key_a").alias("key_a"), F.min("key_b").alias("key_b"))
    out = scratch.store(texts.join(classes, ["key_a", "key_b"]).select("digest", "label"), "result")
    scratch.keep_only(out)
    return out


__all__ = ["bags", "between_classes", "components", "digested", "near_duplicates", "signatures", "text_classes", "texts_of", "verified", "weighted_jaccard"]
