"""Chunkers: texts cut into overlapping pieces.

Fixed and sentence chunkers are column expressions.  The recursive one merges pieces with state and the semantic one
compares neighbouring sentences, so they run as Arrow-batched Python over whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
SCHEMA = "array<struct<chunk:string,start_idx:bigint,end_idx:bigint>>"


def _exploded(docs: DataFrame, chunks) -> DataFrame:
    """(doc_id, pos, chunk, start_idx, end_idx); pos counts a document's chunks from 0."""
    rows = docs.select("doc_id", F.posexplode(chunks).alias("pos", "c"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "c.chunk", "c.start_idx", "c.end_idx")


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of size characters; blank ones are left out; end_idx isn't clamped to the text's end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    text = F.coalesce(F.col("text"), F.lit(""))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    parts = F.transform(starts, lambda a: F.struct(F.substring(text, a + 1, F.lit(size)).alias("chunk"), a.cast("bigint").alias("start_idx"), (a + size).cast("bigint").alias("end_idx")))
    return _exploded(docs, F.filter(parts, lambda c: c["chunk"].rlike(r"\S")))


def sentence_chunks(docs: DataFrame, size: int = 5, overlap: int = 1) -> DataFrame:
    """Windows of size sentences joined by blanks; a window starts where its first sentence is first found."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("s", sentences(F.col("text")))
    starts = F.when(F.size("s") > 0, F.sequence(F.lit(1), F.size("s"), F.lit(size - overlap)))

    def window(a):
        chunk = F.array_join(F.slice("s", a, F.lit(size)), " ")
        start = (F.call_function("locate", F.col("s")[a - 1], F.col("text")) - 1).cast("bigint")
        return F.struct(chunk.alias("chunk"), start.alias("start_idx"), (start + F.length(chunk)).cast("bigint").alias("end_idx"))

    return _exploded(rows, F.transform(starts, window))


def _merged(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Pieces joined up to size; a chunk begins with the last pieces of the one before it that reach overlap, or with all of
    them if they don't.  A running length counts a separator for each piece, but not after the pieces carried over."""
    out, held, length = [], [], 0
    for piece in pieces:
        if held and length + len(piece) + len(sep) > size:
            out.append(sep.join(held))
            reached, first = 0, len(held)
            while first and (reached < overlap or first == len(held)):
                first -= 1
                reached += len(held[first]) + len(sep)
            held = held[first:]
            length = sum(map(len, held)) + len(sep) * (len(held) - 1)
        held.append(piece)
        length += len(piece) + len(sep)
    if held:
        out.append(sep.join(held))
    return [c for c in out if c]


def split_recursively(text: str, size: int = 1000, overlap: int = 200, separators=SEPARATORS) -> list[tuple[str, int, int]]:
    """Pieces by the first separator that makes them all small enough, merged up to size; else windows of size.

    A chunk is looked for from the previous one's end, so an overlapping one may have start -1.
    """
    for sep in separators:
        if sep not in text:
            continue
        pieces = text.split(sep) if sep else list(text)
        if any(len(p) > size for p in pieces):
            continue
        out, at = [], 0
        for chunk in _merged(pieces, sep, size, overlap):
            start = text.find(chunk, at)
            at = start + len(chunk)
            out.append((chunk, start, at))
        return out
    windows = ((text[a : a + size], a) for a in range(0, len(text), size - overlap))
    return [(w, a, a + size) for w, a in windows if w.strip()]


def recursive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    @F.pandas_udf(SCHEMA)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("chunk", "start_idx", "end_idx"), c)) for c in split_recursively(t or "", size, overlap)])

    return _exploded(docs, cut("text"))


def group_sentences(found: list[str], vectors, size: int, least: float) -> list[list[str]]:
    """Runs of sentences; a run ends before one that would make it too long or whose similarity is below least (a zero
    vector has none, and doesn't end it)."""
    import numpy as np

    out: list[list[str]] = []
    length = 0
    for k, s in enumerate(found):
        ends = not out
        if out:
            a, b = vectors[k - 1], vectors[k]
            n = float(np.linalg.norm(a) * np.linalg.norm(b))
            ends = length + len(s) + 1 > size or (n > 0 and float(a @ b) / n < least)
        if ends:
            out.append([s])
            length = len(s)
        else:
            out[-1].append(s)
            length += len(s) + 1
    return out


def semantic_chunks(docs: DataFrame, encode: Callable[[list[str]], object], size: int = 1000, least: float = 0.7) -> DataFrame:
    """Runs of similar sentences; encode gives a row vector for each sentence."""

    @F.pandas_udf(SCHEMA)
    def cut(texts: pd.Series, split: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, split):
            runs = group_sentences(list(found), encode(list(found)), size, least) if len(found) else []
            placed = [(" ".join(g), text.find(g[0])) for g in runs]
            out.append([{"chunk": c, "start_idx": a, "end_idx": a + len(c)} for c, a in placed])
        return pd.Series(out)

    return _exploded(docs, cut(F.coalesce("text", F.lit("")), sentences(F.col("text"))))


def create_chunker(strategy: str, **options) -> Callable[[DataFrame], DataFrame]:
    known = {"fixed": fixed_chunks, "sentence": sentence_chunks, "recursive": recursive_chunks, "semantic": semantic_chunks}
    if strategy not in known:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "semantic" and "encode" not in options:
        raise ValueError("the semantic strategy needs encode")
    return lambda docs: known[strategy](docs, **options)
