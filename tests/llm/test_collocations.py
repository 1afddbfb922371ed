"""Collocations against plain counting, over languages, repeats, ties, odd rows and long texts."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborist.llm import collocations as c


def plain(rows, least, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = total[lang]
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            text = f" {' '.join(p)} "
            if any(len(q) > len(p) and 100 * b >= 100 * a and text in f" {' '.join(q)} " for q, b in candidates.items()):
                continue
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(n=120, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice(["of the", "New York Times", "a", "a a a", "é b c", "x y z u v w", "Über alles", "b", "c", "d\te", "zz zz zz zz"]).split(" ")
            if rng.random() < 0.2:
                words[-1] += rng.choice(".,;:!?\n\r\x0b")
        rows.append((" ".join(words), rng.choice(["en", "fr", None])))
    return rows + [(None, "en"), ("", None), ("... ,, \t", "de"), ("one word", "de")] + rows[:9]


def got(spark, rows, least, top=2000, parts=3):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(parts)
    return sorted(tuple(r) for r in c.collocations(df, least, top).collect())


@pytest.mark.parametrize("least, top", [(3, 2000), (12, 7)])
def test_against_plain(spark, least, top, monkeypatch):
    rows = texts()
    want = plain(rows, least, top)
    assert len(want) > 10 and got(spark, rows, least, top) == want


def test_small_shards_and_batches(spark, monkeypatch):
    """Nodes of many shards add up, also where batches end amid equal nodes."""
    rows = texts(60, 5)
    tries = [list(x) for x in zip(*rows)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(tries[0]), pa.array(tries[1])], ["text", "lang"])
    seed, every = 0, np.full(1 << (c.FILTER_BITS - 3), 255, np.uint8)
    bits = type("B", (), {"value": every})
    monkeypatch.setattr(c, "SHARD_WORDS", 50)
    parts = list(c._tries(seed, 5, bits, bits)(iter([batch.slice(i, 1) for i in range(batch.num_rows)])))
    table = pa.Table.from_batches(parts)
    assert len(parts) > 10
    table = table.sort_by([(k, "ascending") for k in ["lang", *c.PATH]])
    walks = [pa.Table.from_batches(c._walk(2)(iter(table.to_batches(max_chunksize=size)))).to_pylist() for size in (1, 7, 100_000)]
    assert walks[0] == walks[1] == walks[2] and len(walks[0]) > 30
    by_path = {(r["lang"], *(r[w] for w in c.PATH)): r["a"] for r in walks[0]}
    for r in walks[0]:
        depth = sum(r[w] > 0 for w in c.PATH)
        for k in range(2, 5):
            left = (r["lang"], *(r[w] if i < k else 0 for i, w in enumerate(c.PATH)))
            assert r[f"l{k}"] == (by_path[left] if depth > k else None)


@pytest.mark.parametrize("texts", [["p q"], ["p", "q"]])
def test_words_that_share_a_hash_are_seen(texts, monkeypatch):
    """Where all words share a hash, within a batch or between batches, several words of the hash come out."""
    import pyarrow as pa

    monkeypatch.setattr(c, "span_hashes", lambda data, starts, ends, fold, seed: np.full(len(starts), 9, np.uint64))
    batches = [pa.RecordBatch.from_arrays([pa.array([t]), pa.array(["en"])], ["text", "lang"]) for t in texts]
    words = pa.Table.from_batches(c._count_words(0)(iter(batches))).to_pylist()
    assert {r["word"] for r in words} == {"p", "q"} and len({r["h"] for r in words}) == 1


def test_odd_tables(spark, empty, clashing):
    assert c.collocations(empty).collect() == []
    assert c.collocations(clashing, 2).count() > 0
    assert got(spark, [(None, None), ("", "x")], 1) == []
    long = " ".join(random.Random(1).choice("abc") for _ in range(40_000))
    assert got(spark, [(long, "en"), (long[:999], "en")], 100) == plain([(long, "en"), (long[:999], "en")], 100, 2000)


def test_scores_pass_64_bits(spark):
    """floor(1000*a*n / (l*r)) by decimals."""
    rows = [(7 * 10**11 + 13, 9 * 10**14 + 7, 8 * 10**11 + 5, 7 * 10**11 + 99), (100, 10**13, 100, 100)]
    df = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    up = (1000 * F.col("a")).cast("decimal(18,0)") * F.col("n").cast("decimal(19,0)")
    down = F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(19,0)")
    got = [r[0] for r in df.select(F.call_function("div", up, down)).collect()]
    assert got == [1000 * a * n // (left * r) for a, n, left, r in rows]
