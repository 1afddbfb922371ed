"""Hashes of spans, and texts that a polynomial hash takes for one another."""

from __future__ import annotations

import numpy as np
import pytest

from arborist.llm.words import differing, span_hashes, unique_spans


def thue_morse(n):
    """The Thue-Morse word of n letters over a and b, and its complement."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def spans(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return data, ends - [len(t.encode()) for t in texts], ends


@pytest.mark.parametrize("n", [64, 128, 1024, 4096])
def test_thue_morse_words_differ(n):
    a, b = thue_morse(n)
    h = span_hashes(*spans([a, b, a, b[:-1]]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3


def test_equal_spans_alone_hash_alike():
    rng = np.random.RandomState(1)
    texts = ["".join(rng.choice(list("abAB"), rng.randint(0, 150))) for _ in range(3000)] + ["ab", "a", "", "ab" * 90]
    h, folded = span_hashes(*spans(texts)), span_hashes(*spans(texts), True)
    assert len(set(h.tolist())) == len(set(texts)) and len(set(folded.tolist())) == len({t.lower() for t in texts})
    key, first, inverse = unique_spans(*spans(texts))
    assert [texts[i] for i in first[inverse]] == texts and len(key) == len(set(texts))


def test_differing_spans():
    data, starts, ends = spans(["aa", "ab", "aa", "aaa", ""])
    got = differing(data, starts, ends, np.array([0]), np.zeros(5, int))
    assert got.tolist() == [1, 3, 4]
