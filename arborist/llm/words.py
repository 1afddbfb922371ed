"""Words of Arrow text columns as numpy arrays, without a Python object for each word.

A word is a maximal run of word bytes that doesn't cross a document's end; which bytes those are is a table of 256
flags, and A-Z may be folded to a-z before words are hashed.  A word's hash is the sum, modulo 2^64, of pseudo-random values
of its bytes at their positions (a mixer gives a value for each byte and position, so there is no polynomial whose zeros
are known texts), with its length mixed in; equal words have equal hashes in every process and version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 21  # text bytes handled at once; a longer document is a chunk of its own
SMALL_CHUNK = 1 << 20  # for what holds many numbers a byte
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_GOLD = 0x9E3779B97F4A7C15
_VALUES = np.random.RandomState(7).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U) | U(1)
NEAR = 64  # positions whose values are tabulated
_TABLES: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}


_HELD: list = [None, None]


def held(key, make: Callable):
    """What an operator's tasks need, such as a model: made once a worker, for one key at a time.

    Workers are used again by other operators; what an earlier key had made is let go before anything new is made, so a
    worker's memory doesn't add up over the operators of a job.
    """
    if _HELD[0] != key:
        _HELD[:] = None, None
        _HELD[:] = key, make()
    return _HELD[1]


def let_go() -> None:
    """Lets go of what held() has, for operators whose tasks hold nothing."""
    _HELD[:] = None, None
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(seed: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values of all bytes, and of all bytes at each of the first positions."""
    if (seed, fold) not in _TABLES:
        values = mix(_VALUES + U(seed * 0xD1342543DE82EF95 % 2**64)) if seed else _VALUES.copy()
        if fold:
            values[65:91] = values[97:123]
        _TABLES[seed, fold] = values, mix(values + np.arange(NEAR, dtype=U)[:, None] * U(_GOLD)).ravel()
    return _TABLES[seed, fold]


def _places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all bytes of all spans, one span after the other: their places in the data and in their span."""
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + inside, inside


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end]; empty spans hash alike, and so do spans that A-Z alone tells apart if fold is set."""
    values, near = _tables(seed, fold)
    lengths = ends - starts
    places, inside = _places(starts, lengths)
    found = data[places]
    each = near[(np.minimum(inside, NEAR - 1) << 8) | found]
    far = np.flatnonzero(inside >= NEAR)
    if len(far):
        each[far] = mix(values[found[far]] + inside[far].astype(U) * U(_GOLD))
    s = np.zeros(len(each) + 1, U)
    np.cumsum(each, out=s[1:])
    last = np.cumsum(lengths)
    return mix(s[last] - s[last - lengths] + lengths.astype(U) * U(_GOLD))


def differing(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The spans whose bytes aren't those of the first span of their group."""
    like = first[inverse]
    others = np.flatnonzero(like != np.arange(len(starts)))
    like, lengths = like[others], (ends - starts)[others]
    odd = lengths != (ends - starts)[like]
    rest = np.flatnonzero(~odd & (lengths > 0))
    here, inside = _places(starts[others[rest]], lengths[rest])
    unlike = data[here] != data[np.repeat(starts[like[rest]], lengths[rest]) + inside]
    if len(rest):
        odd[rest] = np.logical_or.reduceat(unlike, np.cumsum(lengths[rest]) - lengths[rest])
    return others[odd]


def unique_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, inverse) as np.unique has them of the spans; should spans of one hash differ, another seed is taken."""
    for seed in range(64):
        found = np.unique(span_hashes(data, starts, ends, seed=seed), return_index=True, return_inverse=True)
        if not len(differing(data, starts, ends, *found[1:])):
            return found
    raise ValueError("no seed tells the spans apart")


@dataclass
class Chunk:
    """Some rows of a batch: the table rows, and their texts' bytes with offsets of the rows (one more than rows)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The row that holds each byte position."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def words(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words whose bytes flags has."""
        inside = flags[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.empty(len(inside) + 1, bool)
        before[0], before[1:] = False, inside
        inside = np.append(inside, False)
        return np.flatnonzero(inside & (edge | ~before)), np.flatnonzero(before & (edge | ~inside))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each row, how many of its bytes flags has."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags[self.data], out=total[1:])
        return np.diff(total[self.offsets])

    def texts(self) -> list[str]:
        return pc.fill_null(self.rows.column("text"), "").to_pylist()


def chunk_of(rows: pa.RecordBatch) -> Chunk:
    text = pc.fill_null(rows.column("text"), "").cast(pa.large_binary())
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Chunk(rows, data, offsets - offsets[0])


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of all batches, cut where their texts reach limit bytes; null texts count as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield chunk_of(batch.slice(at, end - at))
            at = end


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(rows, weights, minlength=n)
    return out.astype(np.int64) if weights is None else out


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's entries in an array sorted by row."""
    return np.searchsorted(rows, np.arange(n + 1))
