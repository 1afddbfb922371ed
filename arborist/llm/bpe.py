"""Byte-level BPE by Spark's higher-order functions.

Words are the matches of the tokenizer's pattern.  Distinct words' byte arrays become ids, and a fold merges, step by
step, the neighbours whose joined bytes have the lowest rank (the first of equal ones), as the published algorithm does;
the fold keeps the ranks of neighbours and renews only the two beside a merge.  The ranks of all pairs are a constant map
in two arrays, of which a look-up reads two places.  Decoding concatenates the literal binary pieces of ids.

Texts are cut into units, which are one or more whole words.  Units that occur in a sample of documents (a bounded number)
are folded first, and their ids given to all tasks; so most units of a text need no further fold, whatever the size of the
corpus, and results don't depend on which units those are.  What other words a block of texts has is folded once a block.
Blocks are formed and taken apart by Arrow functions in the same stage, so no text is shuffled.  A block holds BLOCK bytes
of text, or one longer text.

A word of over WINDOW bytes is folded in windows that overlap, and these are joined at tokens that neighbours have in
common (see `stitched`), so a word's cost grows with its length.  Where two windows share none, which takes tokens of over
STEP bytes or long runs, the word is merged by a heap.

Cases: a null text counts as empty and has no ids; repeated rows and null ids are rows like others; an empty table gives
an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import unit_starts
from .spark_io import documents_only
from .words import U, chunks, span_hashes, unique_spans

BLOCK = 5 << 20
WINDOW, STEP = 64, 32  # bytes of a long word's windows, and from one window's start to the next's
SAMPLE_DOCS, SAMPLE_UNITS = 25_000, 1_000_000
_A, _B = 2654435761, 2246822519  # products with pairs stay below 2 ** 63
_SLOTS, _BUCKETS = 1 << 18, 1 << 15
NONE = 1 << 17  # the rank of a pair that isn't a token; ids and ranks are below
_PLACE, _RANK = 17, 24  # bits where a token's place (below 128) and its pair's rank begin


@functools.lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The rank of each pair of tokens whose joined bytes are a token."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a, b] = rank
    return pairs


@functools.lru_cache(2)
def tables(path: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of pairs as a perfect hash: a factor, shifts by bucket, and entries pair * 65536 + rank by place, where a pair is
    left * 65536 + right (see FoldEncoder.rank); ranks of pairs of bytes by left * 256 + right.  What stands at a place that
    isn't a pair's own is another pair."""
    ranks = read_ranks(path)
    if max(ranks.values()) >= 53_000:
        raise ValueError("vocabularies of up to 53,000 tokens fit the hash")
    pairs = {a * 65536 + b: rank for (a, b), rank in pair_ranks(ranks).items()}
    p = np.array(list(pairs), np.int64)
    bucket, factor = p * _A >> 13 & _BUCKETS - 1, _B
    while len(np.unique(bucket * _SLOTS + (place := p * factor >> 16 & _SLOTS - 1))) < len(p):  # pairs of a bucket part by place
        factor -= 2
    shifts, entries = np.zeros(_BUCKETS, np.int32), np.full(_SLOTS, -1, np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(_BUCKETS + 1))
    for k in np.argsort(-np.diff(cut), kind="stable"):
        own = order[cut[k] : cut[k + 1]]
        while (entries[(place[own] + shifts[k]) & _SLOTS - 1] >= 0).any():
            shifts[k] += 1
        entries[(place[own] + shifts[k]) & _SLOTS - 1] = [x * 65536 + pairs[x] for x in p[own].tolist()]
    own = {ranks[bytes([i])]: i for i in range(256)}
    bytes_ = np.full(65536, NONE, np.int32)
    for (a, b), rank in pair_ranks(ranks).items():
        if a in own and b in own:
            bytes_[own[a] * 256 + own[b]] = rank
    return factor, shifts, entries, bytes_


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


class FoldEncoder:
    """Column expressions of a vocabulary.

    shifts, entries and byte_pairs are columns that hold tables(), byte_ids one that holds the bytes' ids.  Block rows carry
    them, a copy for BLOCK bytes of text: as literals of a plan, the optimizer would compare their numbers again and again.
    """

    def __init__(self, path: str, shifts: str = "shifts", entries: str = "entries", byte_pairs: str = "byte_pairs", byte_ids: str = "byte_ids"):
        ranks = read_ranks(path)
        self.edge, self.factor = max(ranks.values()) + 1, tables(path)[0]
        self.shifts, self.entries, self.byte_pairs, self.byte_ids = (F.col(c) for c in (shifts, entries, byte_pairs, byte_ids))
        pieces = [""] * self.edge
        for token, rank in ranks.items():
            pieces[rank] = token.hex()
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def rank(self, a: Column, b: Column) -> Column:
        p = a.cast("bigint") * 65536 + b
        shift = self.shifts[F.shiftright(p * _A, 13).bitwiseAND(_BUCKETS - 1).cast("int")]
        place = (F.shiftright(p * self.factor, 16) + shift).bitwiseAND(_SLOTS - 1).cast("int")
        return let(self.entries[place], lambda e: F.when(F.shiftright(e, 16) == p, e.bitwiseAND(65535).cast("int")).otherwise(F.lit(NONE)))

    def encode(self, word: Column) -> Column:
        """Ids (array of int) of a word, given by its bytes (array of int, at least one and at most WINDOW).

        While it is folded, a word is an array of numbers: of each token the rank of the pair that it begins, the place of its
        first byte, and its id.  So the least number is the pair to merge, the first of equal ranks.  At both ends stands an
        edge, an id that is in no pair; so a merge always has neighbours.
        """
        edge, done = F.lit(self.edge).cast("bigint"), F.lit(NONE << _RANK)

        def token(rank, place, id_):
            return F.shiftleft(rank.cast("bigint"), _RANK) + F.shiftleft(place.cast("bigint"), _PLACE) + id_

        def id_of(x):
            return x.bitwiseAND((1 << _PLACE) - 1)

        def without_rank(x):
            return x.bitwiseAND((1 << _RANK) - 1)

        def merged(tokens, least):
            z = F.shiftright(least, _RANK)  # the joined token's id is its rank

            def at(i):  # the place in the array, from 0, of the pair's first token; never the first or the last two
                before = tokens[i - 1]
                left = F.shiftleft(self.rank(id_of(before), z).cast("bigint"), _RANK) + without_rank(before)
                here = F.shiftleft(self.rank(z, id_of(tokens[i + 2])).cast("bigint"), _RANK) + least.bitwiseAND(((1 << _RANK) - 1) ^ ((1 << _PLACE) - 1)) + z
                beside = F.struct(left.alias("a"), here.alias("b"))
                return let(beside, lambda r: F.filter(F.transform(tokens, lambda x, k: F.when(k == i, r["b"]).when(k == i - 1, r["a"]).otherwise(x)), lambda _, k: k != i + 1))

            return let((F.array_position(tokens, least) - 1).cast("int"), at)

        def step(tokens, _):
            return let(F.array_min(tokens), lambda least: F.when(least >= done, tokens).otherwise(merged(tokens, least)))

        end = F.array(done + edge)
        n = F.size(word)
        first = F.transform(word, lambda b, i: token(F.when(i + 1 < n, self.byte_pairs[b * 256 + F.get(word, i + 1)]).otherwise(F.lit(NONE)), i, self.byte_ids[b]))
        tokens = F.aggregate(F.slice(word, F.lit(2), n), F.concat(end, first, end), step)
        return let(tokens, lambda held: F.transform(F.slice(held, F.lit(2), F.size(held) - 2), lambda x: id_of(x).cast("int")))

    def decode(self, ids: Column) -> Column:
        """The binary text of ids: their literal pieces, concatenated."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: self.pieces[i]), ""))


class Known:
    """Ids of some units: sorted hashes of their bytes, the bytes, and lists of ids."""

    def __init__(self, units: list[bytes], ids: np.ndarray, offsets: np.ndarray):
        data, ends = np.frombuffer(b"".join(units), np.uint8), np.cumsum([0, *map(len, units)])
        hashes = span_hashes(data, ends[:-1], ends[1:]) if units else np.zeros(0, U)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        flat, cut = _gather(ids, offsets, order)
        self.ids, self.offsets = flat.astype(np.uint16), cut.astype(np.int32)
        data, ends = _gather(data, ends, order)
        self.data, self.ends = data, ends.astype(np.int32)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places of units data[start:end], -1 where one isn't known; hashes find them, bytes confirm them."""
        if not len(self.hashes):
            return np.full(len(starts), -1)
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        size = ends - starts
        found = np.flatnonzero((self.hashes[at] == hashes) & (np.diff(self.ends)[at] == size))
        n = size[found]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        odd = data[np.repeat(starts[found], n) + inside] != self.data[np.repeat(self.ends[at[found]], n) + inside]
        out = np.full(len(starts), -1)
        out[found] = at[found]
        out[found[np.repeat(np.arange(len(found)), n)[odd]]] = -1
        return out


class Words:
    """The distinct words of a block.  A unit is a list of words' numbers; a word of over WINDOW bytes is several windows
    that overlap, of which all but the first have their number's complement."""

    def __init__(self):
        import public_tokenizers
        import regex

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.numbers: dict[bytes, int] = {}

    def unit(self, unit: bytes) -> list[int]:
        out, numbers = [], self.numbers
        for piece in self.split(unit.decode()):
            word = piece.encode()
            if len(word) <= WINDOW:
                out.append(numbers.setdefault(word, len(numbers)))
            else:
                for at in range(0, len(word) - WINDOW + STEP, STEP):
                    k = numbers.setdefault(word[at : at + WINDOW], len(numbers))
                    out.append(~k if at else k)
        return out

    def arrays(self) -> pa.Array:
        flat = np.frombuffer(b"".join(self.numbers), np.uint8).astype(np.int32)
        offsets = np.cumsum([0, *map(len, self.numbers)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _units(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all units; start and end of each distinct unit; the distinct unit of each."""
    starts = unit_starts(chunk)
    ends = np.append(starts[1:], len(chunk.data))
    _, first, inverse = unique_spans(chunk.data, starts, ends)
    return starts, starts[first], ends[first], inverse


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _tables(path: str) -> list[pa.Array]:
    ranks = read_ranks(path)
    return [_one(pa.array(x)) for x in (*tables(path)[1:], np.array([ranks[bytes([i])] for i in range(256)], np.int32))]


_TABLES = "shifts array<int>, entries array<bigint>, byte_pairs array<int>, byte_ids array<int>"
_TABLE_NAMES = [x.split()[0] for x in _TABLES.split(", ")]


def _spelt(batches):
    """The distinct units of each BLOCK bytes of text, but for units of over WINDOW bytes."""
    for held in _blocks(batches):
        units = set()
        for chunk in held:
            _, starts, ends, _ = _units(chunk)
            data = chunk.data.tobytes()
            units.update(data[a:b] for a, b in zip(starts.tolist(), ends.tolist()) if b - a <= WINDOW)
        yield pa.RecordBatch.from_arrays([pa.array(list(units), pa.binary())], ["unit"])


def _sampled(path: str, batches):
    """A row of units' bytes, units (their words' numbers) and words for each batch of units."""
    for batch in batches:
        words = Words()
        units = pa.array([words.unit(u) for u in batch.column("unit").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([_one(batch.column("unit")), _one(units), _one(words.arrays()), *_tables(path)], ["spelt", "units", "words", *_TABLE_NAMES])


def _joined(batches):
    """Bytes and ids of each unit of _sampled's rows with their words' ids."""
    for batch in batches:
        for k in range(batch.num_rows):
            spelt, units, words = (batch.column(c)[k].values for c in ("spelt", "units", "ids"))
            numbers, offsets = _flat(units)
            ids, of_word = _gather(*_flat(words), numbers)
            lists = pa.ListArray.from_arrays(pa.array(of_word[offsets].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([spelt, lists], ["unit", "ids"])


def _blocks(batches):
    """Lists of chunks with BLOCK bytes of text, or one longer text."""
    held, size = [], 0
    for chunk in chunks(batches, 1 << 19):  # small chunks, as their arrays are many times their text
        if held and size + len(chunk.data) > BLOCK:
            yield held
            held, size = [], 0
        held.append(chunk)
        size += len(chunk.data)
    if held:
        yield held


def _block_rows(path: str, known, batches):
    """Block rows: doc_ids and how many units each text has, the numbers of all their units (compressed), the ids of known
    units, for each other unit (their numbers go on) the numbers of its words, and words."""
    for held in _blocks(batches):
        words, number, units, docs, texts, sizes, old = Words(), {}, [], [], [], [], []
        for chunk in held:
            starts, low, high, inverse = _units(chunk)
            data, place = chunk.data.tobytes(), known.value.places(chunk.data, low, high)
            local = -1 - place  # known units get a negative number for now
            for i in np.flatnonzero(place < 0).tolist():
                unit = data[low[i] : high[i]]
                k = number.get(unit)
                if k is None:
                    k = number[unit] = len(units)
                    units.append(words.unit(unit))
                local[i] = k
            texts.append(local.astype(np.int32)[inverse])
            sizes.append(np.diff(np.searchsorted(starts, chunk.offsets)))
            docs.append(chunk.rows.column("doc_id"))
        flat = np.concatenate(texts)
        old, back = np.unique(-1 - flat[flat < 0], return_inverse=True)
        new = flat >= 0
        flat[new] += len(old)
        flat[~new] = back
        ids, cut = _gather(known.value.ids, known.value.offsets, old)
        n_units, numbers = np.concatenate(sizes), pa.compress(flat.tobytes(), "zstd", asbytes=True)
        known_ids = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [_one(pa.concat_arrays(docs)), _one(pa.array(n_units, pa.int32())), pa.array([numbers], pa.binary()), _one(known_ids), _one(pa.array(units, pa.list_(pa.int32()))), _one(words.arrays()), *_tables(path)],
            ["doc_ids", "n_units", "numbers", "known", "units", "words", *_TABLE_NAMES],
        )
        del held, texts, flat, inverse, data
        pa.default_memory_pool().release_unused()


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list array."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _gather(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered by pick one after another, and their offsets."""
    size = np.diff(offsets)[pick]
    done = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(done[-1]) + np.repeat(offsets[:-1][pick] - done[:-1], size)], done


def stitched(windows: list[np.ndarray], size: np.ndarray) -> np.ndarray | None:
    """Ids of a word from those of its windows; size has the bytes of each id.

    Neighbouring windows are joined at a token that both have.  Ids are the word's if every two neighbours are the ids of
    their joined bytes, which holds for neighbours within a window; so the join needs no others.  None if two windows have
    no token in common.
    """
    ids, start = windows[0], np.concatenate([[0], np.cumsum(size[windows[0]])])
    for k, further in enumerate(windows[1:], 1):
        at = k * STEP + np.concatenate([[0], np.cumsum(size[further])])
        low = np.searchsorted(start, k * STEP)
        here = {(a, b): i for i, (a, b) in enumerate(zip(start[low:-1].tolist(), start[low + 1 :].tolist()), int(low))}
        for j, span in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if span in here:
                i = here[span]
                ids, start = np.concatenate([ids[:i], further[j:]]), np.concatenate([start[:i], at[j:]])
                break
        else:
            return None
    return ids


def merged_by_heap(word: bytes, path: str) -> list[int]:
    """Ids of a word whose windows have no token in common, such as long runs of one sign: the merges by a heap."""
    ranks = read_ranks(path)
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not alive[a] or end[a] != b or not alive[b] or end[b] != c:
            continue
        alive[b], end[a] = False, c
        if c < n:
            before[c] = a
            if (r := ranks.get(word[a : end[c]])) is not None:
                heapq.heappush(heap, (r, a, c, end[c]))
        p = before[a]
        if p >= 0 and (r := ranks.get(word[p:c])) is not None:
            heapq.heappush(heap, (r, p, a, c))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _unit_ids(numbers: list[int], word, text, size: np.ndarray, path: str) -> np.ndarray:
    """Ids of a unit with long words; word(k) has the ids and text(k) the bytes of a word."""
    out, at = [], 0
    while at < len(numbers):
        end = at + 1
        while end < len(numbers) and numbers[end] < 0:
            end += 1
        windows = [k if k >= 0 else ~k for k in numbers[at:end]]
        ids = stitched([word(k) for k in windows], size)
        if ids is None:
            ids = np.array(merged_by_heap(b"".join(text(k)[:STEP] for k in windows[:-1]) + text(windows[-1]), path), np.int32)
        out.append(ids)
        at = end
    return np.concatenate(out)


def _texts(path: str, batches):
    ranks = read_ranks(path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(t) for t in ranks]
    for batch in batches:
        for k in range(batch.num_rows):
            docs, n_units, known, units, words, spelt = (batch.column(c)[k].values for c in ("doc_ids", "n_units", "known", "units", "ids", "words"))
            numbers, unit_cut = _flat(units)
            ids, word_cut = _flat(words)
            tokens, of_word = _gather(ids, word_cut, np.where(numbers < 0, ~numbers, numbers))
            of_unit = of_word[unit_cut]
            if (numbers < 0).any():
                data, data_cut = _flat(spelt)
                data = data.astype(np.uint8).tobytes()
                word, text = (lambda w: ids[word_cut[w] : word_cut[w + 1]]), (lambda w: data[data_cut[w] : data_cut[w + 1]])
                parts = [tokens[a:b] for a, b in zip(of_unit[:-1], of_unit[1:])]
                for u in np.unique(np.searchsorted(unit_cut, np.flatnonzero(numbers < 0), "right") - 1):
                    parts[u] = _unit_ids(numbers[unit_cut[u] : unit_cut[u + 1]].tolist(), word, text, size, path)
                tokens, of_unit = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            old, old_cut = _flat(known)
            tokens, of_unit = np.concatenate([old, tokens]), np.concatenate([old_cut[:-1], old_cut[-1] + of_unit])
            offsets = np.concatenate([[0], np.cumsum(n_units.to_numpy().astype(np.int64))])
            flat = np.frombuffer(pa.decompress(batch.column("numbers")[k].as_py(), int(offsets[-1]) * 4, "zstd", asbytes=True), np.int32)
            for low in range(0, len(docs), 128):  # so that not all ids of a block are held at once
                high = min(len(docs), low + 128)
                out, at = _gather(tokens, of_unit, flat[offsets[low] : offsets[high]])
                cut = at[offsets[low : high + 1] - offsets[low]]
                out = out.astype(np.int32)
                sha = [hashlib.sha256(out[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(cut[:-1], cut[1:])]
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([docs[low:high], pa.array(np.diff(cut)), pa.array(sha, pa.string()), lists], ["doc_id", "n_tokens", "ids_sha256", "ids"])


def known_units(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS) -> Known:
    """Ids, by the fold, of at most SAMPLE_UNITS distinct units of a sample of about sample_docs documents."""
    folder = FoldEncoder(path)
    n = docs.count()
    sample = docs.sample(min(1.0, sample_docs / n), 1) if n > sample_docs else docs
    spelt = sample.mapInArrow(_spelt, "unit binary").distinct().limit(SAMPLE_UNITS).repartition("unit")
    rows = spelt.mapInArrow(functools.partial(_sampled, path), f"spelt array<binary>, units array<array<int>>, words array<array<int>>, {_TABLES}")
    folded = rows.select("spelt", "units", F.transform("words", folder.encode).alias("ids"))
    units = folded.mapInArrow(_joined, "unit binary, ids array<int>").toArrow().combine_chunks()
    if not units.num_rows:
        return Known([], np.zeros(0, np.int32), np.zeros(1, np.int64))
    return Known(units["unit"].to_pylist(), *_flat(units["ids"].chunk(0)))


def encode(docs: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and ids of every row of docs (doc_id, text); ranks from the file at path."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    folder = FoldEncoder(path)
    docs = documents_only(docs)
    known = docs.sparkSession.sparkContext.broadcast(known_units(docs, path, sample_docs))
    columns = f"doc_ids array<bigint>, n_units array<int>, numbers binary, known array<array<int>>, units array<array<int>>, words array<array<int>>, {_TABLES}"
    blocks = docs.mapInArrow(functools.partial(_block_rows, path, known), columns)
    ids = F.transform("words", folder.encode)
    return blocks.select("doc_ids", "n_units", "numbers", "known", "units", "words", ids.alias("ids")).mapInArrow(functools.partial(_texts, path), "doc_id bigint, n_tokens bigint, ids_sha256 string, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """encoded with a binary column `decoded`."""
    import public_tokenizers

    folder = FoldEncoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded.withColumn("decoded", folder.decode(F.col(column)))
