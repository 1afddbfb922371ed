"""Language ID by cross-parsing entropy (Ziv and Merhav).

For each language a suffix automaton of labelled reference text is built.  A text is cut into phrases, each the longest
match in the reference; c phrases over n symbols against a reference of N symbols estimate the cross-entropy
c * log2(N) / n, and the language with the lowest wins (ties: the first in sorted order).

Texts are parsed as UTF-8 bytes: A-Z folded, bytes 0x80 and up as they are, every other byte a blank.  The automata are
tables, and all texts of a chunk are parsed in lock step, in pieces of PIECE bytes.  A piece is parsed as if a phrase
began with it; then it is parsed again in the state that the piece before it ends in, up to a byte at which both begin a
phrase, from where they are alike.  So phrases are those of the whole text, whatever its length.

Cases: null, empty and letterless texts get `und` and score 0; so does everything if nothing could be learned.  Rows
with a null or repeated doc_id are rows like others; further columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import documents_only, pick, stored
from .words import chunks, held

PIECE = 512
GROUP = 16  # languages parsed at once
CHUNK = 1 << 20  # bytes of text parsed at once
BLANK = 0x20
LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = BLANK


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class CrossParser:
    """Parses chunks of texts against each language's reference."""

    def __init__(self, references: tuple[tuple[str, bytes], ...]):
        self.langs = [k for k, _ in references]
        folded = [_FOLD[np.frombuffer(t, np.uint8)].tobytes() for _, t in references]
        self.bits = np.array([math.log2(max(2, len(t))) for t in folded])
        symbols = sorted(set(b"".join(folded)))
        self.width = len(symbols) + 2  # further: a byte in no reference, and the end of a piece
        self.code = np.full(256, len(symbols), np.uint8 if self.width < 256 else np.uint16)
        self.code[symbols] = np.arange(len(symbols))
        self.code = self.code[_FOLD]
        tables, self.roots = [], []
        for text in folded:
            moves = suffix_automaton(text)
            at = sum(map(len, tables))
            table = np.full((len(moves), self.width), -1, np.int32)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    table[state, self.code[c]] = at + to
            table[:, -1] = at + np.arange(len(moves))
            tables.append(table)
            self.roots.append(at)
        # a last state without a match: before a text, and after a byte that is in no reference and a phrase of its own
        self.none = sum(map(len, tables))
        alone = np.full((1, self.width), -1, np.int32)
        alone[0, -1] = self.none
        self.table = np.concatenate([*tables, alone]).ravel()

    def entropies(self, chunk) -> np.ndarray:
        """Bits a symbol, by row and language; rows without a byte have 0."""
        sizes = np.diff(chunk.offsets)
        pieces = -(-sizes // PIECE)
        row = np.repeat(np.arange(chunk.n), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = chunk.offsets[:-1][row] + nth * PIECE
        end = np.minimum(start + PIECE, chunk.offsets[1:][row])
        data = np.append(self.code[chunk.data], self.code.dtype.type(self.width - 1)).astype(np.int32)
        total = np.zeros((len(self.langs), chunk.n))
        for low in range(0, len(self.langs), GROUP):  # so that the phrases' places stay a few times the text
            roots = np.array(self.roots[low : low + GROUP], np.int32)
            begins = np.zeros((len(roots), len(chunk.data) + 1), bool)
            ends = np.full((len(roots), len(row)), self.none, np.int32)
            lang, piece = (x.ravel() for x in np.indices(ends.shape))
            self._parse(data, roots, lang, piece, start, end, begins, ends, False)
            todo = np.arange(len(lang))[nth[piece] > 0]
            while len(todo):  # pieces whose true state on entry isn't known to have been followed up
                l, p = lang[todo], piece[todo]
                changed = self._parse(data, roots, l, p, start, end, begins, ends, True)
                todo = todo[changed] + 1
                todo = todo[(todo % len(row) > 0) & (nth[piece[np.minimum(todo, len(piece) - 1)]] > 0)] if len(todo) else todo
            for k, own in enumerate(begins):  # one language at a time, as places take eight times their flags' memory
                total[low + k] = np.diff(np.searchsorted(np.flatnonzero(own[:-1]), chunk.offsets))
        return (total * self.bits[:, None] / np.maximum(sizes, 1)).T

    def _parse(self, data, roots, lang, piece, start, end, begins, ends, again: bool) -> np.ndarray:
        """Parses pieces of texts by languages; sets begins (places where phrases begin) and ends (states after pieces).

        again: from the state that the piece before ends in, up to a place where a phrase began before as well.  Gives which
        pieces' last state has changed.
        """
        order = np.argsort(start[piece] - end[piece], kind="stable")
        lang, piece = lang[order], piece[order]
        at, size, root = start[piece], end[piece] - start[piece], roots[lang] * self.width
        state = ends[lang, piece - 1] if again else np.full(len(piece), self.none, np.int32)
        flat, place = begins.reshape(-1), lang * begins.shape[1] + at
        live, met, table = np.arange(len(piece)), np.zeros(len(piece), bool), self.table
        longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # pieces longer than each step
        for step, k in enumerate(longer.tolist()):
            if again:
                live = live[: np.searchsorted(live, k)]  # in order of size
                if not len(live):
                    break
            now = live if again else slice(k)
            sym = data[at[now] + step]
            to = table[state[now] * self.width + sym]
            miss = to < 0
            out = np.flatnonzero(miss)
            fresh = table[(root[now] + sym)[out]]
            fresh[fresh < 0] = self.none
            to[out] = fresh
            state[now] = to
            if again:
                same = miss & flat[place[now] + step]
                flat[place[now] + step] = miss
                met[live[same]] = True
                live = live[~same]
            else:
                flat[place[now] + step] = miss
        changed = np.zeros(len(piece), bool)
        if again:  # what has met the first parse ends as that does
            own = ~met
            changed[own] = ends[lang[own], piece[own]] != state[own]
            ends[lang[own], piece[own]] = state[own]
        else:
            ends[lang, piece] = state
        out = np.zeros(len(piece), bool)
        out[order] = changed
        return out


def _parser(references: tuple[tuple[str, bytes], ...]) -> CrossParser:
    return held(("language", references), lambda: CrossParser(references))


def fit(train: DataFrame, docs_per_lang: int = 16, short: int = 8_000) -> tuple[tuple[str, bytes], ...]:
    """Reference text of every language in train (text, lang, doc_id), from a bounded sample of its rows.

    The sample: of a language's texts of at most `short` characters (of all its texts, if there are none) the docs_per_lang
    with the least hashes of doc_id and text, whole and distinct.
    """
    train = pick(train, doc_id="bigint", text="string", lang="string")
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    rows = rows.withColumn("brief", F.length("text") <= short).withColumn("share", F.pmod(F.xxhash64(F.lit(42), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("brief").cast("bigint")).alias("n_brief"))
    counts = stored(counts, "languages")
    few = rows.join(counts, "lang").where(F.col("brief") == (F.col("n_brief") > 0))
    few = few.where(F.col("share") * F.when(F.col("n_brief") > 0, F.col("n_brief")).otherwise(F.col("n")) < 4 * docs_per_lang + 32)
    texts: dict[str, dict[float, str]] = {}
    for r in few.select("lang", "share", "text").toLocalIterator():
        own = texts.setdefault(r["lang"], {})
        own[r["share"]] = r["text"]
        if len(own) > docs_per_lang:
            del own[max(own)]
    return tuple((lang, " ".join(dict.fromkeys(t for _, t in sorted(texts[lang].items()))).encode()) for lang in sorted(texts))


def predict(docs: DataFrame, references: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs (doc_id, text); score is h2 / (h1 + h2) of the two lowest."""
    langs = [k for k, _ in references]

    def run(batches):
        parser = _parser(references) if references else None
        for chunk in chunks(batches, CHUNK):
            lettered = np.array([LETTER.search(t) is not None for t in chunk.texts()], bool)
            if parser:
                h = parser.entropies(chunk)
                best = h.argmin(1)
                low = h[np.arange(chunk.n), best]
                if len(langs) > 1:
                    h[np.arange(chunk.n), best] = np.inf
                    score = h.min(1) / np.maximum(h.min(1) + low, 1e-12)
                else:
                    score = np.ones(chunk.n)
                names = [langs[i] if ok else "und" for i, ok in zip(best, lettered)]
            else:
                names, score = ["und"] * chunk.n, np.zeros(chunk.n)
            yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return documents_only(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


__all__ = ["CrossParser", "fit", "predict", "suffix_automaton"]
