"""Perplexity by the whole model, whatever part of it tasks hold, and a band for every language."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from arborist.llm import quality_rules

from .test_operators import SPACE_WORD, fold


def brute_force(learnt, texts):
    """Mean -log p a byte of each text: interpolated modified Kneser-Ney over all byte n-grams within words."""

    def places(text):
        for w in SPACE_WORD.findall(fold(text or "")):
            b = f" {w} ".encode()
            yield from (b[max(0, i - 4) : i + 1] for i in range(1, len(b)))

    n = {k: collections.Counter() for k in range(1, 6)}
    for text in learnt:
        for g in places(text):
            n[len(g)][g] += 1
    for k in range(4, 0, -1):
        n[k].update(g[1:] for g in n[k + 1])
    discount, total, taken = {}, {}, {}
    for k in n:
        c = [sum(v == i for v in n[k].values()) for i in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        discount[k] = [min(max(i - (i + 1) * y * c[i + 1] / c[i] if c[i] else i * y, 0.05), i - 0.05) for i in (1, 2, 3)]
        total[k], taken[k] = collections.Counter(), collections.Counter()
        for g, v in n[k].items():
            total[k][g[:-1]] += v
            taken[k][g[:-1]] += v - discount[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        if g[:-1] not in total[k]:
            return p(g[1:])
        back = min(max(1 - taken[k][g[:-1]] / total[k][g[:-1]], 1e-9), 1)
        own = n[k][g] - discount[k][min(n[k][g], 3) - 1] if g in n[k] else 0.0
        return own / total[k][g[:-1]] + back * p(g[1:])

    logs = [[math.log(p(g)) for g in places(t)] for t in texts]
    return [-sum(x) / len(x) if x else None for x in logs]


@pytest.mark.parametrize("held", [1_000_000, 300, 20])
def test_scores_are_those_of_the_whole_model(docs, fixture_rows, held):
    learnt = [t for i, t, *_ in fixture_rows if i is not None and i < 40]
    model = quality_rules.fit(docs.where("doc_id < 40"), held)
    rows = quality_rules.score(docs, model).select("doc_id", "log_ppl").collect()
    want = brute_force(learnt, [t for _, t, *_ in fixture_rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or 0.0)
    for (a, x), (b, y) in zip(sorted(map(tuple, rows), key=key), sorted(((i, y) for (i, *_), y in zip(fixture_rows, want)), key=key)):
        assert a == b and (x == y if y is None else x == pytest.approx(y, abs=1e-9))
    assert all(len(gram) <= held for gram, _ in model.gram.values()) and bool(model.rest) == (held < 1_000_000)


def test_what_tasks_hold_in_part_asks_for_the_rest(docs):
    whole, part = quality_rules.fit(docs), quality_rules.fit(docs, 20)
    grams, p = whole.gram[5]
    held, asked = part.look_up(5, grams)
    assert (asked > 0).any() and (asked >> 40 <= 5).all()
    assert held[asked == 0] == pytest.approx(p[asked == 0], abs=1e-9) and not held[np.isin(asked, (5 << 40) | grams)].any()


def test_every_language_has_a_band_of_its_own(spark):
    rng = random.Random(4)
    text = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(n))
    usual = ["th", "er", "on", "an", "ed", "ha", "ti", "qu"]
    rows = [(i, text(usual, 12), "en") for i in range(10_100)]
    rows += [(20_000 + i, text(usual, 400), f"rare{i}") for i in range(30)]
    rows += [(30_000, " ".join("".join(rng.sample("bcdfgjklmpvwxyz", 5)) for _ in range(400)), "other")]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).where("doc_id >= 20000").collect()
    assert len(out) == 31 and all(r.kept and r.q1 == r.q3 == pytest.approx(r.log_ppl) for r in out)
