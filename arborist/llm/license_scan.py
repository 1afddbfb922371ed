"""License scans: fuzzy search for short notices.

A notice of n words may be found with up to n // EVERY edited words' worth of characters (`edits`).  By the pigeonhole
principle, if a notice is cut into edits + 1 parts, one of them stands unedited in every place within the bound; so
exact places of the parts (one Aho-Corasick automaton for all notices) are the only candidates.  Around each, the regex
library's bounded-error matching verifies the notice, from word to word, and reports its span and edits.  It gives the best
place of a window; what is left on both sides of that is searched again.  Of verified places that overlap, the one with
the least share of edits stays.

Texts are matched with A-Z folded and every run of other characters than words' (ASCII that is neither letter nor
digit) as one blank, so that line breaks and punctuation don't matter.

Base phrases are words that stand consecutively (by word hashes, confirmed on the bytes).  A label's notice adds the
label with its similarity 1 - edits / length; score is the largest one, 1 for a base phrase.

Cases: null and empty texts have no words, no labels and score 0; repeated rows, null ids are rows like others; further
columns aren't read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import documents_only
from .words import chunks, per_row, span_hashes

WORD = np.ones(256, bool)
WORD[:128] = False
WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[65:91] += 32
_BLANKED[~WORD] = 32

#: Fixed values of the query's contract: phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices of well-known licenses, in the form that texts are matched in, with labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)
CHARS_PER_EDIT = 12


def edits_of(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def parts(notice: str, n: int) -> list[tuple[int, str]]:
    """n + 1 parts of nearly equal length, and where they start."""
    cuts = [len(notice) * i // (n + 1) for i in range(n + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...]):
        import ahocorasick
        import regex

        self.notices = [(t, label, edits_of(t)) for t, label in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (t, _, n) in enumerate(self.notices):
            for a, part in parts(t, n):
                seeds.setdefault(part, []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for part, places in seeds.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(t)}){{e<={n}}}(?![^ ])") for t, _, n in self.notices]

    def windows(self, text: str) -> list[tuple[int, int, int]]:
        """Merged candidate windows (notice, start, end)."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, a in places:
                t, _, n = self.notices[k]
                start = end + 1 - size - a
                found.setdefault(k, []).append((max(0, start - n), start + len(t) + n))
        out = []
        for k, spans in found.items():
            spans.sort()
            low, high = spans[0]
            for a, b in spans[1:]:
                if a > high:
                    out.append((k, low, high))
                    low = a
                high = max(high, b)
            out.append((k, low, high))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of verified places in a blanked text; they begin and end with words."""
        out = []
        for k, a, b in self.windows(text):
            # whole words, as the end of the searched part counts as the text's
            left = [(text.rfind(" ", 0, a) + 1, end if (end := text.find(" ", min(b, len(text)))) >= 0 else len(text))]
            while left:
                a, b = left.pop()
                m = self.patterns[k].search(text, a, b)
                if m and m.end() > m.start():
                    s, e = m.span()
                    out.append((s, e, self.notices[k][1], sum(m.fuzzy_counts), len(self.notices[k][0])))
                    left += [(a, s), (e, b)]
        # of places that overlap, the one with the least share of edits stays (the longest of equals)
        best: list[tuple[int, int, str, int, int]] = []
        for f in sorted(set(out), key=lambda f: (f[3] / f[4], -f[4], f)):
            if all(f[1] <= b[0] or f[0] >= b[1] for b in best):
                best.append(f)
        return sorted(best)


@functools.lru_cache(2)
def scanner(notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(notices)


def _phrases(chunk, starts, ends, rows, h):
    """For each phrase, the indices of words where it begins."""
    for phrase, label in PHRASES:
        words = [np.frombuffer(w.encode(), np.uint8) for w in phrase.split()]
        keys = [span_hashes(w, np.array([0]), np.array([len(w)]), True)[0] for w in words]
        m = max(0, len(h) - len(keys) + 1)
        hit = np.ones(m, bool)
        for k, key in enumerate(keys):
            hit &= (h[k : k + m] == key) & (ends[k : k + m] - starts[k : k + m] == len(words[k]))
        at = np.flatnonzero(hit)
        for k, word in enumerate(words):  # hashes find places, bytes confirm them
            found = _BLANKED[chunk.data[starts[at + k][:, None] + np.arange(len(word))]]
            at = at[(found == word).all(1)]
        yield label, at[rows[at] == rows[at + len(keys) - 1]] if len(at) else at


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, matches and score of every row of docs.

    matches: array of (start, end, label, edits, length) from the notices; start and end in the document's code points.
    """

    def run(batches):
        s = scanner(notices)
        for chunk in chunks(batches):
            starts, ends = chunk.words(WORD)
            rows, n = chunk.row_of(starts), chunk.n
            h = span_hashes(chunk.data, starts, ends, True)
            begin = np.searchsorted(rows, np.arange(n))
            total, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            for label, at in _phrases(chunk, starts, ends, rows, h):
                row, nth = rows[at], at - begin[rows[at]]
                total += per_row(row, n)
                np.minimum.at(first, row, nth)
                np.maximum.at(last, row, nth)
                for i in np.unique(row).tolist():
                    labels[i].add(label)
            data, cut = _BLANKED[chunk.data].tobytes(), chunk.offsets.tolist()
            points = np.concatenate([[0], np.cumsum(~_CONTINUES[chunk.data])])
            matches, score = [], (total > 0).astype(float)
            for i in range(n):
                text = data[cut[i] : cut[i + 1]].decode()
                squeezed = " ".join(text.split(" ")) if "  " not in text else " ".join(w for w in text.split(" ") if w)
                # a place begins and ends with words, which have their own places in the document
                found = []
                for a, b, *rest in s.scan(squeezed):
                    k, j = (begin[i] + squeezed.count(" ", 0, x) for x in (a, b))
                    found.append((int(points[starts[k]] - points[cut[i]]), int(points[ends[j]] - points[cut[i]]), *rest))
                matches.append([dict(zip(("start", "end", "label", "edits", "length"), f)) for f in found])
                if found:
                    score[i] = max(score[i], *(1 - f[3] / f[4] for f in found))
            none = total == 0
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.rows.column("doc_id"),
                    pa.array(per_row(rows, n)),
                    pa.array(total),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(matches, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("length", pa.int64())]))),
                    pa.array(score),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches", "score"],
            )

    return documents_only(docs).mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "matches array<struct<start:bigint,end:bigint,label:string,edits:bigint,length:bigint>>, score double",
    )


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows with labels (the base's and the notices', sorted, comma-joined) and notices (label:start:end:edits by
    place, comma-joined) in place of matches."""
    own = F.transform("matches", lambda m: m["label"])
    every = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("base_labels", ","), lambda x: x != ""), own)))
    places = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["start"], m["end"], m["edits"])), ",")
    return found.withColumn("labels", F.array_join(every, ",")).withColumn("notices", places).drop("matches")
