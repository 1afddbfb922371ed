"""A sparse rule ensemble (RuleFit) for text quality.

Shallow trees are boosted over statistics of texts; each path from a root to a node is a rule, a conjunction of
conditions `statistic < threshold` or `>= threshold`.  A lasso-penalised logistic regression over all rules keeps a few
with weights, and those are compiled into one Spark column expression over the statistics' columns.

Fitting takes a bounded sample of labelled rows (`max_rows`, by a hash of doc_id) and runs on the driver; scoring covers
every row.  Inputs of a score are statistics of the text alone.

Cases: a null text counts as empty, whose statistics are 0; without labels the score is 0.5, with one class alone it is
that class's share, kept off 0 and 1; repeated labels of a doc_id are averaged; null ids and labels aren't learned from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import base_stats
from .spark_io import documents_only, pick
from .words import SPACES, chunks, per_row, span_hashes

_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>", "loud": b"!?", "stop": b".,;:", "line": b"\n", "wide": range(128, 256), "at": b"@=+_/\\"}
STATISTICS = ("log_words", "word_bytes", "distinct", "top_share", "repeat_share", "dup_lines", "upper_share", "digit_share", "wide_share", "symbols", "louds", "stops", "lines", "ats")


def _flags(b) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b)] = True
    return out


_FLAGS = {k: _flags(b) for k, b in _CLASSES.items()}


def chunk_statistics(chunk) -> np.ndarray:
    """STATISTICS by row."""
    starts, ends = chunk.words(~SPACES)
    rows, n = chunk.row_of(starts), chunk.n
    words, _, _, dup, repeat = base_stats(chunk, starts, ends, rows).astype(float)
    h = span_hashes(chunk.data, starts, ends, True)
    order = np.lexsort((h, rows))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    first = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, rows[order][first], np.diff(np.append(first, len(h))))
    some, size = np.maximum(words, 1), np.maximum(np.diff(chunk.offsets), 1)
    of = {k: chunk.sums(f) for k, f in _FLAGS.items()}
    inside = per_row(rows, n, ends - starts)
    return np.stack(
        [np.log1p(words), inside / some, per_row(rows[order][first], n) / some, top / some, repeat / some, dup / np.maximum(of["line"] + 1, 1)]
        + [of[k] / size for k in ("upper", "digit", "wide")]
        + [of[k] / some for k in ("symbol", "loud", "stop", "line", "at")]
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every row of docs (doc_id, text)."""

    def run(batches):
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), *map(pa.array, chunk_statistics(chunk))], ["doc_id", *STATISTICS])

    return documents_only(docs).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, whether it is at least, the threshold), sorted


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as one expression over the columns of STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = reduce(lambda a, b: a & b, (F.col(c) >= t if least else F.col(c) < t for c, least, t in rule))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (x[STATISTICS.index(c)] >= t if least else x[STATISTICS.index(c)] < t for c, least, t in rule))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, rate: float, least: int) -> list[Rule]:
    """Paths of boosted trees (logistic loss) to all their nodes but the roots; x is statistics by rows."""
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for v in x]
    binned = [np.searchsorted(e, v, "right") for e, v in zip(edges, x)]
    score, found = np.zeros(len(y)), []

    def grow(rows, path, left):
        g, h = grad[rows], hess[rows]
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[f][rows]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, None))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            score[rows] += rate * g.sum() / (h.sum() + 1)
            return
        f, k = best[1]
        up = binned[f][rows] > k
        for side in (False, True):
            longer = (*path, (STATISTICS[f], side, float(edges[f][k])))
            found.append(tuple(sorted(longer)))
            grow(rows[up == side], longer, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        grow(np.arange(len(y)), (), depth)
    return list(dict.fromkeys(found))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, m = r.shape
    scale = r.std(0) + 1e-3
    z = (r - r.mean(0)) / scale
    w, v, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    w[0] = v[0] = np.log(y.mean() / (1 - y.mean()))
    step = np.ones(n) / np.sqrt(n)
    u = np.ones(m) / np.sqrt(m)
    for _ in range(20):  # the largest singular value
        step = z @ u
        u = z.T @ step
        norm = np.linalg.norm(u)
        u /= norm + 1e-12
    rate = 1 / (0.25 * (norm / n + 1) + 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v[1:] + v[0])))
        g = np.concatenate([[(p - y).mean()], z.T @ (p - y) / n])
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    weights = w[1:] / scale
    return float(w[0] - weights @ r.mean(0)), weights


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 40, depth: int = 3, penalty: float = 5e-4) -> RuleEnsemble:
    """The ensemble for labels (doc_id, label 0 or 1) of docs (doc_id, text), from at most about max_rows of them."""
    labels = pick(labels, doc_id="bigint", label="double").toDF("_id", "_label").dropna()
    n = labels.count()
    share = F.pmod(F.xxhash64(F.lit(17), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labels.where(share < max_rows / max(n, 1)).groupBy("_id").agg((F.avg("_label") >= 0.5).cast("double").alias("_label"))
    # about max_rows rows of two numbers, so the broadcast is bounded
    chosen = documents_only(docs).join(F.broadcast(sample.select("_id")), F.col("doc_id") == F.col("_id"), "left_semi")
    rows = statistics(chosen).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).toArrow()
    y = rows.column("_label").to_numpy()
    if not len(y) or y.min() == y.max():
        p = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x, y = np.stack([rows.column(c).to_numpy()[order] for c in STATISTICS]), y[order]
    rules = tree_rules(x, y, trees, depth, 64, 0.3, max(5, len(y) // 1000))
    if not rules:
        p = float(y.mean())
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    intercept, weights = lasso(np.stack([_holds(r, x) for r in rules], 1).astype(float), y, penalty)
    return RuleEnsemble(intercept, tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def classify(docs: DataFrame, ensemble: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if the score is at least threshold) of every row of docs."""
    rows = statistics(docs).select("doc_id", ensemble.column().alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
