"""Training of the navigation policy: losses with their gradients by hand, steps over partitions, AdamW on the driver.

Rows: row_id, x (state), action, done, loops (per action, 1 where it would loop), and lists `jump` and `retrieve` of
candidates (v, sim, p, l: vector, similarity, positive, would loop), null where a row has none.  Every candidate of a list
counts; rows of a batch are padded within a task, and padding has no gradient.

A step is one job over its batch, which is a folder of its own, so nothing else is read: tasks give the gradient of their rows
as slices, which are summed by Spark before the driver gets one vector (some 830,000 numbers, whatever the batch).  What
losses are divided by depends on labels and masks alone, and is counted for all batches before.  The driver clips, and moves
the weights of each group by AdamW at its rate; groups without a rate are frozen.  Gradients of a row are the same when a task
runs again, as dropout is drawn from the row's id and the step.

Cases: a batch whose loss isn't finite is skipped; a batch without jumps (or retrievals, loops) has no such loss; without
validation rows the last weights are the result; an empty table gives the weights as they came and no history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import normalised
from ..sources.layout import stored
from . import supervision as V
from .policy import AGGREGATE, JUMP, RETRIEVE, gelu, layer, meta_features, state_vector, unit
from .tree import ROOT, parent, path_nodes

LOSSES = ("action", "jump", "jump_loop", "action_loop", "done", "retrieve")
SLICES = 16
CANDIDATE = "struct<v:array<double>,sim:double,p:int,l:int>"
ROW = f"row_id bigint, x array<double>, action int, done double, loops array<int>, jump array<{CANDIDATE}>, retrieve array<{CANDIDATE}>"


@dataclass(frozen=True)
class TrainConfig:
    phase: int = 3
    epochs: int = 5
    batch_rows: int = 256
    base_rate: float = 1e-3
    warm_rate: float = 5e-4
    encoder_rate: float = 1e-4
    decay: float = 1e-4
    clip: float = 1.0
    betas: tuple[float, float] = (0.9, 0.95)
    dropout: float = 0.1
    warmup: float = 0.05
    floor: float = 0.1
    patience: int = 5
    watch: str = "jump_top_1"
    seed: int = 42
    shares: dict = field(default_factory=lambda: {"action": 1.0, "jump": 1.0, "jump_loop": 0.05, "action_loop": 0.05, "done": 0.3, "retrieve": 1.0})

    def share(self, loss: str) -> float:
        """The weight of a loss; those of the heads that phases 1 and 2 freeze are 0 there."""
        return 0.0 if loss in ("done", "retrieve") and self.phase < 3 else self.shares[loss]


# ---- losses: each gives a value a row (0 where it doesn't count), which rows count, and the gradient by its logits

def _softmax(logits: np.ndarray, mask: np.ndarray) -> np.ndarray:
    masked = np.where(mask, logits, -np.inf)
    top = masked.max(-1, keepdims=True, initial=-np.inf)
    e = np.where(mask, np.exp(masked - np.where(np.isfinite(top), top, 0.0)), 0.0)
    return e / np.maximum(e.sum(-1, keepdims=True), 1e-300)


def _log_sum(logits: np.ndarray, mask: np.ndarray) -> np.ndarray:
    masked = np.where(mask, logits, -np.inf)
    top = masked.max(-1, initial=-np.inf)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.where(mask, np.exp(masked - safe[..., None]), 0.0).sum(-1))


def listwise(logits: np.ndarray, mask: np.ndarray, positive: np.ndarray):
    """Cross-entropy of the positives' joint share among the candidates."""
    positive = positive & mask
    counts = positive.any(-1)
    loss = np.where(counts, _log_sum(logits, mask) - np.where(counts, _log_sum(logits, positive), 0.0), 0.0)
    return np.where(counts, loss, 0.0), counts, np.where(counts[:, None], _softmax(logits, mask) - _softmax(logits, positive), 0.0)


def loop_mass(logits: np.ndarray, mask: np.ndarray, loops: np.ndarray, most: float = 1 - 1e-6):
    """-log(1 - the share of what would loop)."""
    loops = loops & mask
    counts = loops.any(-1)
    p = _softmax(logits, mask)
    bad = (p * loops).sum(-1)
    grad = p * (loops - bad[:, None]) / (1 - np.minimum(bad, most))[:, None]
    return np.where(counts, -np.log1p(-np.minimum(bad, most)), 0.0), counts, np.where((counts & (bad < most))[:, None], grad, 0.0)


def weighted_cross_entropy(logits: np.ndarray, label: np.ndarray, weights: np.ndarray):
    p = _softmax(logits, np.ones_like(logits, bool))
    w, rows = weights[label], np.arange(len(label))
    grad = p.copy()
    grad[rows, label] -= 1
    return w * (_log_sum(logits, np.ones_like(logits, bool)) - logits[rows, label]), w, w[:, None] * grad


def binary_cross_entropy(logit: np.ndarray, label: np.ndarray, positive_weight: float):
    soft = np.logaddexp(0.0, -np.abs(logit))
    yes, no = soft + np.maximum(-logit, 0), soft + np.maximum(logit, 0)  # -log of p and of 1 - p
    p = np.exp(-yes)
    return positive_weight * label * yes + (1 - label) * no, np.ones(len(label), bool), -positive_weight * label * (1 - p) + (1 - label) * p


# ---- network

def _layer_back(w, grads, name, kept, d):
    x, n, inverse, y = kept
    d = d * gelu(y, 1)
    grads[f"{name}.norm.g"] += (d * n).reshape(-1, n.shape[-1]).sum(0)
    grads[f"{name}.norm.o"] += d.reshape(-1, n.shape[-1]).sum(0)
    d = d * w[f"{name}.norm.g"]
    d = inverse * (d - d.mean(-1, keepdims=True) - n * (d * n).mean(-1, keepdims=True))
    grads[f"{name}.w"] += x.reshape(-1, x.shape[-1]).T @ d.reshape(-1, d.shape[-1])
    grads[f"{name}.b"] += d.reshape(-1, d.shape[-1]).sum(0)
    return d @ w[f"{name}.w"].T


def _linear_back(w, grads, name, x, d):
    grads[f"{name}.w"] += x.reshape(-1, x.shape[-1]).T @ d.reshape(-1, d.shape[-1])
    grads[f"{name}.b"] += d.reshape(-1, d.shape[-1]).sum(0)
    return d @ w[f"{name}.w"].T


class Batch:
    """Rows as arrays; candidates are padded to the longest list."""

    def __init__(self, rows: pd.DataFrame):
        self.ids = rows["row_id"].to_numpy()
        self.x = np.array([list(v) for v in rows["x"]], float).reshape(len(rows), -1)
        self.action = rows["action"].to_numpy().astype(int)
        self.done = rows["done"].to_numpy().astype(float)
        self.loops = np.array([[False] * 3 if v is None else list(v) for v in rows["loops"]], bool).reshape(len(rows), 3)
        self.lists = {kind: self._padded(rows[kind]) for kind in ("jump", "retrieve")}

    @staticmethod
    def _padded(column):
        lists = [[] if c is None else list(c) for c in column]
        width = max([1, *map(len, lists)])
        dim = next((len(c["v"]) for row in lists for c in row), 1)
        v, sim = np.zeros((len(lists), width, dim)), np.zeros((len(lists), width))
        mask, p, loop = (np.zeros((len(lists), width), bool) for _ in range(3))
        for i, row in enumerate(lists):
            for k, c in enumerate(row):
                v[i, k], sim[i, k], mask[i, k], p[i, k], loop[i, k] = c["v"], c["sim"], True, bool(c["p"]), bool(c["l"])
        return v, sim, mask, p, loop


def _scores(w, kind, h, v, sim):
    f = np.concatenate([np.repeat(h[:, None], v.shape[1], 1), v, sim[..., None]], -1)
    a, kept = layer(w, f"{kind}1", f)
    return (a @ w[f"{kind}2.w"] + w[f"{kind}2.b"])[..., 0], (a, kept)


def _kept_units(ids: np.ndarray, step: int, seed: int, width: int, dropout: float) -> np.ndarray:
    """1 / (1 - dropout) or 0 for each unit of each row."""
    draws = np.stack([np.random.RandomState([seed, step, int(i) & 0x7FFFFFFF, (int(i) >> 31) & 0x7FFFFFFF]).rand(width) for i in ids])
    return (draws >= dropout) / (1 - dropout)


def losses(w: dict, b: Batch, class_weights: np.ndarray, positive_weight: float, config: TrainConfig, divisors: dict | None, step: int = 0):
    """Sums and divisors of the losses of rows; with divisors (of the whole batch), also the gradient of the total loss."""
    a1, kept1 = layer(w, "enc1", b.x)
    drop = _kept_units(b.ids, step, config.seed, a1.shape[1], config.dropout) if config.dropout > 0 and divisors is not None else 1.0
    a1 = a1 * drop
    h, kept2 = layer(w, "enc2", a1)
    logits, done = h @ w["action.w"] + w["action.b"], (h @ w["done.w"] + w["done.b"])[:, 0]
    found = {"action": weighted_cross_entropy(logits, b.action, class_weights), "action_loop": loop_mass(logits, np.ones_like(b.loops), b.loops), "done": binary_cross_entropy(done, b.done, positive_weight)}
    scored = {}
    for kind in ("jump", "retrieve"):
        v, sim, mask, p, loop = b.lists[kind]
        if not mask.any():
            none = np.zeros(len(b.ids))
            found[kind] = none, none > 0, None
            if kind == "jump":
                found["jump_loop"] = found[kind]
            continue
        s, cache = _scores(w, kind, h, v, sim)
        scored[kind] = cache
        found[kind] = listwise(s, mask, p)
        if kind == "jump":
            found["jump_loop"] = loop_mass(s, mask, loop)
    sums = {k: float(found[k][0].sum()) for k in LOSSES}
    counts = {k: float(found[k][1].sum()) for k in LOSSES}
    if divisors is None:
        return sums, counts, None
    rate = {k: config.share(k) / divisors[k] if divisors[k] > 0 else 0.0 for k in LOSSES}
    grads = {k: np.zeros(v.shape) for k, v in w.items()}
    d = rate["action"] * found["action"][2] + rate["action_loop"] * found["action_loop"][2]
    dh = _linear_back(w, grads, "action", h, d)
    if rate["done"]:
        dh = dh + _linear_back(w, grads, "done", h, (rate["done"] * found["done"][2])[:, None])
    for kind, (a, kept) in scored.items():
        d = rate[kind] * found[kind][2]
        if kind == "jump":
            d = d + rate["jump_loop"] * found["jump_loop"][2]
        if not d.any():
            continue
        back = _layer_back(w, grads, f"{kind}1", kept, _linear_back(w, grads, f"{kind}2", a, d[..., None]))
        dh = dh + back[..., : h.shape[1]].sum(1)
    _layer_back(w, grads, "enc1", kept1, _layer_back(w, grads, "enc2", kept2, dh) * drop)
    return sums, counts, grads


# ---- optimiser

def rates(names, config: TrainConfig) -> dict[str, float]:
    """The rate of each weight; 0 where its group is frozen."""
    out = {}
    for name in names:
        part = name.split(".")[0].rstrip("12")
        fresh = part in ("done", "retrieve")
        if config.phase < 3:
            out[name] = 0.0 if fresh else config.base_rate
        else:
            out[name] = config.base_rate if fresh else config.encoder_rate if part == "enc" else config.warm_rate
    return out


def multiplier(step: int, total: int, warmup: float, floor: float) -> float:
    """Linear warm-up, then a cosine from 1 to floor."""
    first = max(1, int(warmup * total))
    if step < first:
        return max(step / first, 1e-8)
    return floor + (1 - floor) * 0.5 * (1 + math.cos(math.pi * min(1.0, (step - first) / max(1, total - first))))


class AdamW:
    """Moments of each weight; decay apart from the gradient."""

    def __init__(self, weights: dict, config: TrainConfig):
        self.config, self.rates, self.t = config, rates(weights, config), 0
        self.m = {k: np.zeros(v.shape) for k, v in weights.items()}
        self.v = {k: np.zeros(v.shape) for k, v in weights.items()}

    def move(self, weights: dict, grads: dict, by: float) -> dict:
        moving = [k for k, r in self.rates.items() if r > 0]
        norm = math.sqrt(sum(float((grads[k] ** 2).sum()) for k in moving))
        shrink = min(1.0, self.config.clip / (norm + 1e-6))
        self.t += 1
        (b1, b2), out = self.config.betas, dict(weights)
        for k in moving:
            g = grads[k] * shrink
            self.m[k] = b1 * self.m[k] + (1 - b1) * g
            self.v[k] = b2 * self.v[k] + (1 - b2) * g * g
            rate = self.rates[k] * by
            step = (self.m[k] / (1 - b1**self.t)) / (np.sqrt(self.v[k] / (1 - b2**self.t)) + 1e-8)
            out[k] = weights[k] * (1 - rate * self.config.decay) - rate * step
        return out


# ---- rows

def training_rows(records: DataFrame, features: DataFrame, queries: DataFrame, vectors: DataFrame, members: DataFrame, config, max_depth: int, most: int = 256) -> DataFrame:
    """ROW for each record (records.records(), under its config): vectors by joins on nodes and documents, a state in Arrow batches.

    features are policy.node_features(); queries (query_id, embedding), vectors (doc_id, embedding), members (doc_id, node_id).
    What would loop: candidates that were visited or are the node itself, unless positive; aggregation right back to where the
    path came from, unless that is the action.
    """
    asked = queries.select("query_id", normalised(F.col("embedding")).alias("q"))
    docs = vectors.select("doc_id", normalised(F.col("embedding")).alias("v")).join(members.select("doc_id", F.col("node_id").alias("leaf")), "doc_id")
    rows = records.withColumn("row_id", F.xxhash64("trajectory_id", "step", "repeat"))
    known = features.select("node_id", F.col("centroid").alias("v"))
    path = rows.select("row_id", F.posexplode("path").alias("i", "node_id")).join(known, "node_id").groupBy("row_id").agg(F.collect_list("v").alias("path_v"))
    found = rows.select("row_id", F.explode("evidence").alias("doc_id")).join(docs, "doc_id").groupBy("row_id").agg(F.collect_list(F.struct("leaf", "v")).alias("found"))
    options = rows.where(F.col("candidates").isNotNull()).select("row_id", "node_id", "path", "positives", F.posexplode("candidates").alias("i", "c"))
    options = options.join(known.withColumnRenamed("node_id", "c"), "c").withColumn("p", F.array_contains("positives", F.col("i")))
    loop = ~F.col("p") & ((F.col("c") == F.col("node_id")) | F.array_contains("path", F.col("c")))
    options = options.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", "v", F.col("p").cast("int").alias("p"), loop.cast("int").alias("l")))).alias("options"))
    retrieved = rows.where(F.col("action") == V.RETRIEVE)
    at = retrieved.select("query_id", "node_id").distinct()
    below = members.select("doc_id", F.explode(path_nodes(F.col("node_id"))).alias("node_id")).join(vectors.select("doc_id", "embedding"), "doc_id")
    wanted = retrieved.select("query_id", F.explode("relevant").alias("doc_id")).distinct()
    block = V.nearest_block(at, below, wanted, queries, most).join(docs, "doc_id")
    block = block.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("place", "v", F.col("positive").cast("int").alias("p")))).alias("block"))
    up = parent(F.col("node_id"))
    back = F.coalesce((F.size("path") > 1) & (F.get("path", F.size("path") - 2) == up) & (F.col("action") != V.AGGREGATE), F.lit(False))
    label = F.when(F.col("action") == V.RETRIEVE, RETRIEVE).when(F.col("action") == V.AGGREGATE, AGGREGATE).otherwise(JUMP)
    state = rows.select("row_id", "query_id", "node_id", label.alias("action"), F.col("done").cast("double").alias("done"), F.size("path").alias("path_n"), F.size("evidence").alias("found_n"), "retrieves", "jumps", "step", "docs_left", "calls_left", back.cast("int").alias("back"))
    whole = state.join(asked, "query_id").join(features, "node_id").join(path, "row_id", "left").join(found, "row_id", "left").join(options, "row_id", "left").join(block, ["query_id", "node_id"], "left")

    def listed(items, q, loops):
        return None if items is None else [{"v": list(c["v"]), "sim": float(np.dot(q, c["v"])), "p": int(c["p"]), "l": int(c["l"]) if loops else 0} for c in items]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                q = unit(np.asarray(r["q"], float))
                vec = lambda v, q=q: np.zeros(len(q)) if v is None else np.asarray(v, float)
                total = lambda vs, q=q: np.zeros(len(q)) if vs is None else np.sum([np.asarray(v, float) for v in vs], 0)
                held = [] if r["found"] is None else list(r["found"])
                inside = sum(r["node_id"] == ROOT or x["leaf"] == r["node_id"] or x["leaf"].startswith(r["node_id"] + ".") for x in held)
                meta = meta_features(r["depth"] / max(1, max_depth), r["n_docs"], bool(r["is_leaf"]), r["parent_id"] is not None, r["path_n"], r["found_n"], r["retrieves"], r["jumps"], r["docs_left"] / config.max_docs, r["calls_left"] / config.max_calls, r["step"], inside, float(q @ vec(r["centroid"])))
                x = state_vector(q, vec(r["centroid"]), vec(r["up"]), vec(r["down"]), total(r["path_v"]), total([e["v"] for e in held] or None), meta)
                jump = listed(r["options"], q, True) if r["action"] == JUMP else None
                out.append((r["row_id"], x.tolist(), r["action"], r["done"], [0, int(r["back"]), 0], jump, listed(r["block"], q, False) if r["action"] == RETRIEVE else None))
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in ROW.split(", ")])

    return stored(whole.mapInPandas(run, ROW))


# ---- Spark

def _flat(grads: dict) -> np.ndarray:
    return np.concatenate([grads[k].ravel() for k in sorted(grads)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "values": [np.sum([np.asarray(v) for v in rows["values"]], 0)]})


def gradient(rows: DataFrame, weights: dict, class_weights: np.ndarray, positive_weight: float, config: TrainConfig, divisors: dict, step: int) -> tuple[dict, dict]:
    """Losses (each divided by its divisor) and gradient of a batch: slices of the tasks' vectors, added by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]):
        total, value = None, np.zeros(len(LOSSES))
        for batch in batches:
            if len(batch):
                sums, _, grads = losses(shared.value, Batch(batch), class_weights, positive_weight, config, divisors, step)
                total = _flat(grads) if total is None else total + _flat(grads)
                value += [sums[k] for k in LOSSES]
        if total is not None:
            parts = [value, *np.array_split(total, SLICES)]
            yield pd.DataFrame({"slice": range(len(parts)), "values": parts})

    added = rows.mapInPandas(run, "slice int, values array<double>").groupBy("slice").applyInPandas(_added, "slice int, values array<double>")
    parts = {r["slice"]: np.array(r["values"], float) for r in added.toLocalIterator()}  # a NaN comes back as null
    shared.unpersist()
    sums = dict(zip(LOSSES, parts[0]))
    return {k: sums[k] / divisors[k] if divisors[k] > 0 else 0.0 for k in LOSSES}, _shaped(np.concatenate([parts[i + 1] for i in range(SLICES)]), weights)


def divisors_of(batches: DataFrame, class_weights: np.ndarray) -> dict[int, dict]:
    """What each batch's losses are divided by: class weights, rows, or rows that have positives or loops."""
    has = lambda c, f: F.coalesce(F.exists(c, lambda x: x[f] > 0), F.lit(False))
    weight = F.get(F.array(*(F.lit(float(w)) for w in class_weights)), F.col("action"))
    each = {
        "action": F.sum(weight), "done": F.count("*").cast("double"), "jump": F.sum(has("jump", "p").cast("double")), "retrieve": F.sum(has("retrieve", "p").cast("double")),
        "jump_loop": F.sum(has("jump", "l").cast("double")), "action_loop": F.sum(F.coalesce(F.exists("loops", lambda x: x > 0), F.lit(False)).cast("double")),
    }
    found = batches.groupBy("batch").agg(*(c.alias(k) for k, c in each.items())).collect()
    return {r["batch"]: {k: float(r[k] or 0.0) for k in LOSSES} for r in found}


def balance(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of the three actions, total / (3 * (n + 1)), and negatives a positive of done (10 without positives)."""
    counts = {(r["action"], r["yes"]): r["n"] for r in rows.groupBy("action", (F.col("done") > 0.5).alias("yes")).agg(F.count("*").alias("n")).collect()}
    total, yes = sum(counts.values()), sum(n for (_, d), n in counts.items() if d)
    of = [sum(n for (a, _), n in counts.items() if a == k) for k in range(3)]
    return np.array([total / (3 * (n + 1)) for n in of]), (total - yes) / yes if yes else 10.0


def predictions(rows: DataFrame, weights: dict) -> DataFrame:
    """row_id, action, predicted, done, done_predicted, and ranks of the first positive among jumps and retrievals (null: none)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def rank(s, mask, p):
        best = np.where(p & mask, s, -np.inf).max(-1)
        before = (mask & (s > best[:, None])).sum(-1)
        tied = mask & (s == best[:, None])  # ties by place
        first = np.argmax(p & tied, -1)
        before = before + (tied & (np.arange(s.shape[1]) < first[:, None])).sum(-1)
        return [int(r) + 1 if ok else None for r, ok in zip(before, (p & mask).any(-1))]

    def run(batches):
        w = shared.value
        for batch in batches:
            if not len(batch):
                continue
            b = Batch(batch)
            h, _ = layer(w, "enc2", layer(w, "enc1", b.x)[0])
            out = {"row_id": b.ids, "action": b.action, "predicted": (h @ w["action.w"] + w["action.b"]).argmax(-1), "done": b.done > 0.5, "done_predicted": (h @ w["done.w"] + w["done.b"])[:, 0] > 0}
            for kind in ("jump", "retrieve"):
                v, sim, mask, p, _ = b.lists[kind]
                out[f"{kind}_rank"] = pd.array(rank(_scores(w, kind, h, v, sim)[0], mask, p) if mask.any() else [None] * len(b.ids), dtype="Int64")
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, "row_id bigint, action int, predicted int, done boolean, done_predicted boolean, jump_rank bigint, retrieve_rank bigint")


def metrics(predicted: DataFrame) -> DataFrame:
    """One row: accuracy of actions, jumps' top 1, top 3 and MRR, done's accuracy, precision, recall and F1, retrievals' top 5."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    hit, said, real = F.sum((F.col("done") & F.col("done_predicted")).cast("double")), F.sum(F.col("done_predicted").cast("double")), F.sum(F.col("done").cast("double"))
    precision, recall = F.coalesce(hit / F.greatest(said, F.lit(1.0)), F.lit(0.0)), F.coalesce(hit / F.greatest(real, F.lit(1.0)), F.lit(0.0))
    ranked = F.when(F.col("jump_rank").isNotNull(), F.col("jump_rank"))
    return predicted.agg(
        F.count("*").alias("rows"), share(F.col("action") == F.col("predicted")).alias("action_acc"), share(ranked <= 1).alias("jump_top_1"), share(ranked <= 3).alias("jump_top_3"), F.coalesce(F.avg(1.0 / ranked), F.lit(0.0)).alias("jump_mrr"),
        share(F.col("done") == F.col("done_predicted")).alias("done_acc"), precision.alias("done_precision"), recall.alias("done_recall"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))).alias("done_f1"), share(F.col("retrieve_rank") <= 5).alias("retrieve_top_5"),
    )


def train(rows: DataFrame, weights: dict, config: TrainConfig = TrainConfig(), validation: DataFrame | None = None) -> tuple[dict, list[dict]]:
    """The best weights by the watched metric of the validation rows, and an entry an epoch: mean losses and metrics."""
    names = [c.strip().split(" ")[0] for c in ROW.split(", ")]
    rows = rows.select(*names)
    n = rows.count()
    n_batches = max(1, n // config.batch_rows)
    placed = rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(config.seed), "row_id"), F.lit(n_batches)).cast("int"))
    placed = stored(placed, "batch")
    class_weights, positive_weight = balance(rows) if n else (np.ones(3), 10.0)
    divisors = divisors_of(placed, class_weights)
    w = {k: np.asarray(v, float) for k, v in weights.items()}
    optimiser, history, best, since, step = AdamW(w, config), [], (-math.inf, w), 0, 0
    for epoch in range(1, config.epochs + 1) if n else ():
        order = np.random.RandomState([config.seed, epoch]).permutation(sorted(divisors))
        sums, used = dict.fromkeys(LOSSES, 0.0), 0
        for k in order.tolist():
            value, grads = gradient(placed.where(F.col("batch") == k).select(*names), w, class_weights, positive_weight, config, divisors[k], step)
            if not (np.isfinite(list(value.values())).all() and all(np.isfinite(g).all() for g in grads.values())):
                continue
            w = optimiser.move(w, grads, multiplier(step, config.epochs * len(divisors), config.warmup, config.floor))
            sums, used, step = {name: sums[name] + x for name, x in value.items()}, used + 1, step + 1
        entry = {"epoch": epoch, "steps": step, **{f"loss_{name}": x / max(1, used) for name, x in sums.items()}}
        entry["loss"] = sum(config.share(name) * entry[f"loss_{name}"] for name in LOSSES)
        if validation is not None:
            entry |= metrics(predictions(validation.select(*names), w)).first().asDict()
        history.append(entry)
        watched = entry.get(config.watch, -entry["loss"])
        if watched > best[0] + 1e-6:
            best, since = (watched, w), 0
        else:
            since += 1
            if since >= config.patience:
                break
    return (best[1] if validation is not None else w), history


__all__ = ["AdamW", "Batch", "TrainConfig", "balance", "divisors_of", "gradient", "losses", "metrics", "multiplier", "predictions", "rates", "train", "training_rows"]
