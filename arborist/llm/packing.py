"""Vector bin packing: sequences under limits on tokens, segments and loss-bearing tokens at once.

The dot-product heuristic: a sequence takes, again and again, the fitting example whose demands (each a share of its
limit) have the largest dot product with what the sequence has left; so an example that is large where much room is
left goes first.  `pack_examples` does this for whole examples, `pack_documents` for documents that may be cut:

Documents become token ids (byte-level BPE of the `tokenizers` library, then END).  Each is cut into whole sequences and
a rest; rests are packed by the heuristic, and where none fits, the largest is cut to fill what is left.  A sequence
that the limit of segments closes early, and the few at the end of a task, are cut at powers of two, which need no
padding.  Every task packs its own input as a stream, so nothing is shuffled, what a task holds is bounded by a chunk
and a carry of under a few sequences, and a task that is run again gives the same rows.

Tokens: as the tokenizer's pattern never joins characters over certain places (before white space that follows other
characters, between an ASCII letter and other ASCII punctuation), texts are cut there, and each distinct unit is encoded
once a chunk; a bounded cache keeps units between chunks, by their bytes.  The file's added tokens, such as <|endoftext|>, are
found first, as the library does, and are one id where they stand.

Cases: a null text counts as empty and is END alone; repeated rows and null ids are packed like others; an empty table
gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import documents_only, pick
from .words import SPACES, chunks, held, unique_spans

END = 1
TOKENS, SEGMENTS = 2048, 128
CACHE = 150_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = np.zeros(256, bool)  # ASCII that is neither letter, digit nor white space
_OTHER[:128] = True
_OTHER[[*range(48, 58), 0x20, *range(0x09, 0x0E)]] = False
_OTHER &= ~_LETTER


def unit_starts(chunk) -> np.ndarray:
    """Places where the pattern surely starts a match: rows' starts among them (of rows with text)."""
    d = chunk.data
    if not len(d):
        return np.zeros(0, np.int64)
    space, letter, other = SPACES[d], _LETTER[d], _OTHER[d]
    # the last byte of a character of two bytes that is a letter: U+00C0 to U+00FF but for two signs
    latin = np.zeros(len(d), bool)
    latin[1:] = (d[:-1] == 0xC3) & (d[1:] != 0x97) & (d[1:] != 0xB7)
    known = letter | latin
    cut = np.zeros(len(d), bool)
    cut[1:] = (space[1:] & (known | other | ((d >= 48) & (d < 58)))[:-1]) | (other[1:] & known[:-1])
    cut[chunk.offsets[:-1][np.diff(chunk.offsets) > 0]] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    """Ids of units of text, by the model of a tokenizers file; caches at most 2 * CACHE units."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        # the visible characters that byte-level files use for bytes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        assert file["model"]["type"] == "BPE"
        self.added = {t["content"].encode(): array("I", [t["id"]]).tobytes() for t in file["added_tokens"]}
        self.find_added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or b"(?!)").finditer

    def encode(self, unit: bytes) -> bytes:
        if unit in self.added:
            return self.added[unit]
        out: list[int] = []
        for piece in self.split(unit.decode("utf-8", "replace")):
            out += [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]
        return array("I", out).tobytes()

    def _around_added(self, chunk, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Units' starts with those of added tokens, and of what follows them; a token's own string isn't cut further."""
        spans = np.array([m.span() for m in self.find_added(data)], np.int64).reshape(-1, 2)
        spans = spans[chunk.row_of(spans[:, 0]) == chunk.row_of(spans[:, 1] - 1)]
        if not len(spans):
            return starts
        before = np.searchsorted(spans[:, 0], starts, "right") - 1
        inside = (before >= 0) & (starts > spans[before, 0]) & (starts < spans[before, 1])
        ends = spans[:, 1]
        return np.unique(np.concatenate([starts[~inside], spans[:, 0], ends[ends < len(data)]]))

    def ids(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts one after another, and the offsets of its rows."""
        data = chunk.data.tobytes()
        starts = self._around_added(chunk, data, unit_starts(chunk))
        ends = np.append(starts[1:], len(chunk.data))
        _, first, inverse = unique_spans(chunk.data, starts, ends)
        found = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist()):
            unit = data[a:b]
            ids = self.new.get(unit)
            if ids is None:
                ids = self.old.pop(unit, None)
                if ids is None:
                    ids = self.encode(unit)
                if len(self.new) >= CACHE:
                    self.old, self.new = self.new, {}
                self.new[unit] = ids
            found.append(ids)
        size = np.array([len(x) for x in found], np.int64) // 4
        flat, at = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size
        n = size[inverse]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(done[-1]) + np.repeat(at[inverse] - done[:-1], n)]
        return ids, done[np.searchsorted(starts, chunk.offsets)]


def encoder(path: str) -> UnitEncoder:
    return held(("encoder", path), lambda: UnitEncoder(path))


def choose(demand: np.ndarray, left: np.ndarray, limits: np.ndarray) -> int:
    """The fitting row of demand with the largest dot product with left (both as shares of limits); -1 if none fits."""
    if not len(demand):
        return -1
    score = np.where((demand <= left).all(1), (demand / limits) @ (left / limits), -1.0)
    best = int(score.argmax())
    return best if score[best] >= 0 else -1


def pack(demand: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Rows of demand (whole examples) by sequence.  An example beyond the limits is a sequence of its own."""
    rest = [int(i) for i in range(len(demand))]
    out = [[i] for i in rest if (demand[i] > limits).any()]
    open_ = np.array([i for i in rest if (demand[i] <= limits).all()], int)
    while len(open_):
        left, taken = limits.astype(float), []
        while (k := choose(demand[open_], left, limits)) >= 0:
            left = left - demand[open_[k]]
            taken.append(int(open_[k]))
            open_ = np.delete(open_, k)
        out.append(taken)
    return out


class Packer:
    """Packs documents that may be cut.  Items: [doc_id, ids, start, whole document's tokens]."""

    def __init__(self, tokens: int, segments: int, loss: int, first: int):
        self.limits = np.array([tokens, segments, loss], float)
        self.items: list[list] = []
        self.sequence, self.rows = first, []

    @staticmethod
    def loss(ids: np.ndarray, start: int) -> int:
        """All but a document's first id bear loss."""
        return len(ids) - (start == 0)

    def emit(self, pieces: list[list]) -> None:
        offset = 0
        for doc, ids, start, size in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), size, self.sequence, offset, self.loss(ids, start)))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        most, size, start = int(min(self.limits[0], self.limits[2])), len(ids), 0
        while size - start >= most:
            self.emit([[doc, ids[start : start + most], start, size]])
            start += most
        if start < size:
            self.items.append([doc, ids[start:], start, size])

    def flush(self, last: bool = False) -> None:
        """Sequences from the items; unless it is the last call, items that don't fill one stay."""
        demand = np.array([[len(i[1]), 1, self.loss(i[1], i[2])] for i in self.items], float).reshape(-1, 3)
        alive = list(range(len(self.items)))
        while alive and (last or demand[alive, 0].sum() >= self.limits[0]):
            left, taken, rows = self.limits.copy(), [], np.array(alive)
            while len(rows) and left[0] > 0 and left[1] > 0 and left[2] > 0:
                k = choose(demand[rows], left, self.limits)
                if k >= 0:
                    i = int(rows[k])
                    taken.append(self.items[i])
                    left -= demand[i]
                    rows = np.delete(rows, k)
                else:  # none fits: the largest is cut
                    i = int(rows[demand[rows, 0].argmax()])
                    doc, ids, start, size = self.items[i]
                    n = int(min(left[0], left[2], len(ids) - 1))
                    if n < 1:
                        break
                    taken.append([doc, ids[:n], start, size])
                    self.items[i] = [doc, ids[n:], start + n, size]
                    demand[i] = len(ids) - n, 1, self.loss(ids[n:], start + n)
                    left -= [n, 1, self.loss(ids[:n], start)]
            alive = rows.tolist()
            total = sum(len(p[1]) for p in taken)
            while total:
                n = total if total == self.limits[0] else 1 << (total.bit_length() - 1)
                part, taken = _cut(taken, n)
                self.emit(part)
                total -= n
        self.items = [self.items[i] for i in alive]


def _cut(pieces: list[list], n: int) -> tuple[list[list], list[list]]:
    """The first n tokens of pieces, and the others."""
    part: list[list] = []
    for at, (doc, ids, start, size) in enumerate(pieces):
        if n <= len(ids):
            part.append([doc, ids[:n], start, size])
            rest = [[doc, ids[n:], start + n, size]] if n < len(ids) else []
            return part, rest + pieces[at + 1 :]
        part.append([doc, ids, start, size])
        n -= len(ids)
    return part, []


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


def pack_documents(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None) -> DataFrame:
    """Pieces of all docs (doc_id, text) by sequence; ids by the tokenizers file at path (the public byte-level BPE)."""

    def run(batches):
        import public_tokenizers

        units = encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        packer = Packer(tokens, segments, loss or tokens, TaskContext.get().partitionId() << 32)

        def rows():
            columns = list(zip(*packer.rows)) or [()] * 8
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in _SCHEMA.split(", ")])

        for chunk in chunks(batches):
            ids, at = units.ids(chunk)
            for k, doc in enumerate(chunk.rows.column("doc_id").to_pylist()):
                packer.add(doc, np.append(ids[at[k] : at[k + 1]], np.uint32(END)))
            packer.flush()
            yield rows()
        packer.flush(last=True)
        yield rows()

    return documents_only(docs).mapInArrow(run, _SCHEMA)


def conversation_demands(turns: DataFrame, path: str | None = None, learned: str = "assistant") -> DataFrame:
    """id, tokens, segments and loss of each conversation of turns (conv_id, role, text).

    A turn is its text's ids and END; a segment is a turn; loss bear the tokens of the role `learned`.  Turns are summed by
    conversation before they are shuffled, so one may hold any share of the rows.  Null texts count as empty, null roles as
    others; turns without a conv_id are one conversation of id null.
    """

    def run(batches):
        import public_tokenizers

        units = encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        for chunk in chunks(batches):
            _, at = units.ids(chunk)
            yield pa.RecordBatch.from_arrays([chunk.rows.column("conv_id"), chunk.rows.column("role"), pa.array(np.diff(at) + 1)], ["id", "role", "tokens"])

    counted = pick(turns, conv_id="bigint", role="string", text="string").mapInArrow(run, "id bigint, role string, tokens bigint")
    loss = F.when(F.col("role") == learned, F.col("tokens")).otherwise(0)
    return counted.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum(loss).alias("loss"))


def pack_examples(examples: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, window: int = 4096) -> DataFrame:
    """Sequences of whole examples (id, tokens, segments, loss); each task packs windows of its own rows.

    Gives id, sequence_id, tokens, segments and loss for every row; null demands count as 0.
    """
    limits = np.array([tokens, segments, loss or tokens], float)

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, window):
                part = batch.slice(k, window)
                demand = np.stack([np.nan_to_num(part.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("tokens", "segments", "loss")], 1)
                sequence = np.zeros(part.num_rows, np.int64)
                for members in pack(demand, limits):
                    sequence[members] = at
                    at += 1
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sequence), *(pa.array(d) for d in demand.astype(np.int64).T)], ["id", "sequence_id", "tokens", "segments", "loss"])

    examples = pick(examples, id="bigint", tokens="bigint", segments="bigint", loss="bigint")
    return examples.mapInArrow(run, "id bigint, sequence_id bigint, tokens bigint, segments bigint, loss bigint")
