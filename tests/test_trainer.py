"""The policy's losses by hand, gradients by finite differences, frozen groups, and training that learns and resumes alike."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from arborist.operators import policy as P
from arborist.operators import trainer as T

CONFIG = P.PolicyConfig(dim=4, hidden=6, scorer=5)
WEIGHTS = {k: np.asarray(v, float) for k, v in P.init_weights(CONFIG, 5).items()}
HEADS = np.array([1.5, 0.7, 1.1])


def rows(n, seed=0):
    """Rows whose action and positives follow from their state and candidates."""
    rng = np.random.RandomState(seed)
    out = []
    for i in range(n):
        x = rng.randn(CONFIG.state_dim)
        action = int(np.argmax(x[:3]))

        def candidates(k, first):
            v = rng.randn(k, 4)
            return [{"v": c.tolist(), "sim": float(c @ x[:4]), "p": int(j == int(np.argmax(v @ x[:4]))), "l": int(j == first)} for j, c in enumerate(v)]

        out.append((i, x.tolist(), action, float(x[5] > 0.5), [0, int(action != 1 and i % 3 == 0), 0], candidates(rng.randint(2, 6), 0 if i % 4 == 0 else -1) if action == 2 else None, candidates(rng.randint(1, 7), -1) if action == 0 else None))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, T.ROW)


def pandas(data):
    return pd.DataFrame(data, columns=["row_id", "x", "action", "done", "loops", "jump", "retrieve"])


def test_erf_and_gelu():
    x = np.linspace(-8, 8, 4001)
    assert np.abs(P.erf(x) - [math.erf(v) for v in x]).max() < 1e-12
    assert np.abs((P.gelu(x + 1e-5) - P.gelu(x - 1e-5)) / 2e-5 - P.gelu(x, 1)).max() < 1e-8


def test_losses_by_hand():
    s = np.array([[2.0, 1.0, 0.5, -1.0]])
    every, positive = np.ones((1, 4), bool), np.array([[1, 1, 0, 0]], bool)
    want = math.log(sum(map(math.exp, s[0]))) - math.log(math.exp(2) + math.exp(1))
    assert T.listwise(s, every, positive)[0][0] == pytest.approx(want)
    assert T.listwise(s, every, ~every)[1].sum() == 0 and T.listwise(s, ~every, positive)[0][0] == 0
    padded = np.array([[1, 1, 0, 0]], bool)
    loss, _, grad = T.listwise(s, padded, np.array([[1, 0, 0, 1]], bool))  # a positive that is padding doesn't count
    assert loss[0] == pytest.approx(math.log(1 + math.exp(-1))) and (grad[0, 2:] == 0).all() and (grad[0, :2] != 0).all()
    low, high = (T.loop_mass(np.array([x]), np.ones((1, 3), bool), np.array([[0, 1, 0]], bool))[0][0] for x in ([3.0, -3, 2], [-3.0, 3, -2]))
    assert 0 <= low < high
    value, w, _ = T.weighted_cross_entropy(np.array([[0.0, 0, 0], [1.0, 0, 0]]), np.array([1, 0]), HEADS)
    assert value.sum() / w.sum() == pytest.approx((0.7 * math.log(3) + 1.5 * (math.log(math.e + 2) - 1)) / 2.2)
    assert T.binary_cross_entropy(np.array([0.3, -900.0]), np.array([1.0, 0.0]), 4.0)[0] == pytest.approx([4 * math.log(1 + math.exp(-0.3)), 0.0])


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradient_equals_finite_differences(dropout):
    config = T.TrainConfig(dropout=dropout)
    batch = T.Batch(pandas(rows(40, 6)))
    _, counts, _ = T.losses(WEIGHTS, batch, HEADS, 3.0, config, None)
    assert all(counts[k] > 0 for k in T.LOSSES)
    value = lambda w: sum(config.share(k) * x / counts[k] for k, x in T.losses(w, batch, HEADS, 3.0, config, counts, 7)[0].items())
    grads = T.losses(WEIGHTS, batch, HEADS, 3.0, config, counts, 7)[2]
    rng = np.random.RandomState(1)
    for name, g in grads.items():
        for at in rng.choice(g.size, min(6, g.size), False):
            ends = []
            for by in (1e-5, -1e-5):
                w = {k: v.copy() for k, v in WEIGHTS.items()}
                w[name].ravel()[at] += by
                ends.append(value(w))
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g.ravel()[at], rel=1e-4, abs=1e-8), name


def test_partitions_add_up(spark):
    """Losses and gradient of a batch don't depend on how its rows are dealt."""
    data = rows(40, 2)
    config = T.TrainConfig()
    counts = T.divisors_of(frame(spark, data).selectExpr("*", "3 batch"), HEADS)[3]
    sums, own, grads = T.losses(WEIGHTS, T.Batch(pandas(data)), HEADS, 3.0, config, counts, 2)
    assert own == pytest.approx(counts)
    value, dealt = T.gradient(frame(spark, data).repartition(5), WEIGHTS, HEADS, 3.0, config, counts, 2)
    assert value == pytest.approx({k: sums[k] / counts[k] for k in T.LOSSES})
    assert all(np.allclose(dealt[k], grads[k], atol=1e-12) for k in grads)


def test_groups_and_optimiser():
    one, three = (T.rates(WEIGHTS, T.TrainConfig(phase=p)) for p in (1, 3))
    assert {k for k, r in one.items() if r == 0} == {k for k in WEIGHTS if k.startswith(("done", "retrieve"))}
    assert three["enc1.w"] == 1e-4 and three["jump2.b"] == 5e-4 and three["done.w"] == 1e-3
    assert T.balance and T.multiplier(0, 100, 0.05, 0.1) == 1e-8 and T.multiplier(5, 100, 0.05, 0.1) == 1 and T.multiplier(100, 100, 0.05, 0.1) == pytest.approx(0.1)
    grads = {k: np.full(v.shape, 1e6) for k, v in WEIGHTS.items()}
    moved = T.AdamW(WEIGHTS, T.TrainConfig(phase=2)).move(WEIGHTS, grads, 1.0)
    assert all(np.array_equal(moved[k], WEIGHTS[k]) == (one[k] == 0) for k in WEIGHTS)
    # a first step is the rate for every gradient, whatever its size, after decay
    assert moved["enc1.w"] == pytest.approx(WEIGHTS["enc1.w"] * (1 - 1e-7) - 1e-3, abs=1e-6)


def test_training_learns(spark):
    data, held = rows(300, 3), rows(80, 4)
    config = T.TrainConfig(epochs=6, batch_rows=60, base_rate=2e-2, warm_rate=2e-2, encoder_rate=2e-2, dropout=0.0, watch="action_acc")
    w, history = T.train(frame(spark, data).repartition(2), WEIGHTS, config, frame(spark, held))
    assert [h["epoch"] for h in history] == [*range(1, 7)] and history[-1]["loss"] < 0.8 * history[0]["loss"]
    assert history[-1]["action_acc"] > 0.6
    frozen, _ = T.train(frame(spark, data[:60]), WEIGHTS, T.TrainConfig(phase=1, epochs=1, batch_rows=60))
    assert all(np.array_equal(frozen[k], WEIGHTS[k]) == k.startswith(("done", "retrieve")) for k in WEIGHTS)
    # ranks and metrics of a trained network, against plain counting
    got = {r.row_id: r for r in T.predictions(frame(spark, held), w).collect()}
    for i, x, action, done, _, jump, _ in held:
        h = P.encode(w, np.array(x))
        assert got[i].predicted == int(np.argmax(P.heads(w, h)[0])) and got[i].done_predicted == (P.heads(w, h)[1] > 0.5)
        if jump:
            s = P.candidate_scores(w, "jump", h, np.array([c["v"] for c in jump]), np.array([c["sim"] for c in jump]))
            assert got[i].jump_rank == 1 + sum(s > s[[c["p"] for c in jump].index(1)])
        else:
            assert got[i].jump_rank is None


def test_odd_tables(spark):
    w, history = T.train(frame(spark, []), WEIGHTS)
    assert history == [] and all(np.array_equal(w[k], WEIGHTS[k]) for k in WEIGHTS)
    bare = [(1, [float("nan")] * CONFIG.state_dim, 0, 0.0, None, None, None)]
    w, history = T.train(frame(spark, bare), WEIGHTS, T.TrainConfig(epochs=1))
    assert history[0]["steps"] == 0 and all(np.array_equal(w[k], WEIGHTS[k]) for k in WEIGHTS)
