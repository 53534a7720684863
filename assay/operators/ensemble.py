"""Search of ensemble weights over matrix blocks: every point of the simplex in the same pass.

A block's row holds the posteriors of all members side by side. The first pass multiplies them by the
whole weight matrix and counts (point, class, bin of the posterior, hit); thresholds come out of running
sums over the bins. The second counts decisions by (point, true class, decided class).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import posterior as po
from assay.operators.blocks import Block, Sums, fit_all, to_blocks
from assay.operators.selection import THRESHOLD_GRID, weight_grid

#: posteriors, over weight points, rows and classes, that a block works on at once
AT_ONCE = 1 << 18
METRICS = ("bal_acc", "accuracy", "f1_macro", "recall")


def mixed(x: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """(points, rows, classes), half up at 9 decimals; members are added in their order."""
    own = x.reshape(len(x), -1, k)
    p = weights[:, 0, None, None] * own[None, :, 0]
    for m in range(1, weights.shape[1]):
        p += weights[:, m, None, None] * own[None, :, m]
    p *= 1e9
    p += 0.5
    return np.floor(p, out=p) / 1e9


def pieces(b: Block, points: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of some rows at a time."""
    step = max(1, AT_ONCE // (points * k))
    for lo in range(0, len(b.y), step):
        yield b.x[lo:lo + step], b.y[lo:lo + step]


def bins(p: np.ndarray) -> np.ndarray:
    """How many thresholds of the grid lie at or below each value."""
    return np.clip(np.floor((p - THRESHOLD_GRID[0]) * 40 + 1e-8) + 1, 0, len(THRESHOLD_GRID)).astype(np.int64)


def lowest_argmax(v: np.ndarray) -> np.ndarray:
    return (v >= v.max(axis=-1, keepdims=True) - po.TIE).argmax(axis=-1)


class _Counts:
    def __init__(self, weights: np.ndarray, k: int):
        self.weights, self.k = weights, k

    def __call__(self, b: Block) -> np.ndarray:
        k, size, m = self.k, len(THRESHOLD_GRID) + 1, len(self.weights)
        out = np.zeros((m, k, size, 2))
        first = (np.arange(m)[:, None, None] * k + np.arange(k)) * size
        for x, y in pieces(b, m, k):
            at = bins(mixed(x, self.weights, k))
            cell = (first + at) * 2 + (y[:, None] == np.arange(k))[None]
            out += np.bincount(cell.ravel(), minlength=out.size).reshape(out.shape)
        return out


class _Decisions:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, k: int):
        self.weights, self.thresholds, self.k = weights, thresholds, k

    def __call__(self, b: Block) -> np.ndarray:
        k, m = self.k, len(self.weights)
        out = np.zeros((m, k, k))
        t = np.clip(self.thresholds, 1e-6, 0.999999)[:, None, :]
        for x, y in pieces(b, m, k):
            p = mixed(x, self.weights, k)
            over = p >= t
            decided = np.where(over.any(axis=2), lowest_argmax(np.where(over, p / t, -1.0)), lowest_argmax(p))
            cell = (np.arange(m)[:, None] * k + y[None, :]) * k + decided
            out += np.bincount(cell.ravel(), minlength=out.size).reshape(out.shape)
        return out


def scores(confusion: np.ndarray, metric: str) -> np.ndarray:
    """Of (..., true, decided) counts; classes without rows don't count, except in F1 where they have been decided."""
    hit = np.einsum("...kk->...k", confusion)
    rows, decided = confusion.sum(axis=-1), confusion.sum(axis=-2)
    if metric == "accuracy":
        return hit.sum(axis=-1) / np.maximum(rows.sum(axis=-1), 1)
    if metric == "f1_macro":
        seen = rows + decided > 0
        return (2 * hit / np.maximum(rows + decided, 1)).sum(axis=-1) / np.maximum(seen.sum(axis=-1), 1)
    return (hit / np.maximum(rows, 1)).sum(axis=-1) / np.maximum((rows > 0).sum(axis=-1), 1)


class WeightSearch:
    """Best weights by ``metric`` (balanced accuracy, accuracy, macro F1 or mean recall) with thresholds tuned by it at every point.

    ``min_recall`` is what a class but ``normal_idx`` must reach for a threshold to count; a class where none does keeps 0.5. The
    default weights come first and win ties, then the grid in order. Values of thresholds are compared at ``decimals``, None for as they are.
    """

    def __init__(self, members: list[str], k: int, step: float = 0.1, metric: str = "bal_acc", min_recall: float = 0.0, normal_idx: int | None = None,
                 decimals: int | None = 12):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
        self.k, self.metric, self.min_recall, self.normal_idx, self.decimals = k, metric, min_recall, normal_idx, decimals
        self.weights = np.array([po.default_weights(members), *weight_grid(len(members), step)])

    def thresholds(self, counts: np.ndarray) -> np.ndarray:
        """(points, classes)."""
        above = counts[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]  # bin above i: at or above threshold i
        fp, tp = above[..., 0], above[..., 1]
        n, p = (counts[..., i].sum(axis=2)[..., None] for i in (0, 1))
        recall = tp / np.maximum(p, 1)
        value = {"accuracy": (tp + n - fp) / np.maximum(p + n, 1), "f1_macro": 2 * tp / np.maximum(p + tp + fp, 1), "recall": recall}.get(
            self.metric, np.where(n > 0, (recall + (n - fp) / np.maximum(n, 1)) / 2, recall))
        ok = np.broadcast_to(p > 0, value.shape).copy()
        if self.min_recall > 0:
            ok &= (recall >= self.min_recall) | (np.arange(self.k) == (-1 if self.normal_idx is None else self.normal_idx))[None, :, None]
        best = np.where(ok, value if self.decimals is None else np.round(value, self.decimals), -1.0)
        return np.where(ok.any(axis=2), np.array(THRESHOLD_GRID)[best.argmax(axis=2)], 0.5)

    def best(self, sums: Sums) -> tuple[int, list[float], float]:
        """(point, thresholds, score)."""
        t = self.thresholds(sums(_Counts(self.weights, self.k)))
        value = scores(sums(_Decisions(self.weights, t, self.k)), self.metric)
        at = int(np.round(value, 9).argmax())
        return at, t[at].tolist(), float(value[at])

    def __call__(self, sums: Sums, candidate: int) -> bytes:
        at, thresholds, value = self.best(sums)
        return pickle.dumps((self.weights[at].tolist(), thresholds, value))


def weight_search(preds: DataFrame, members: list[str], k: int, cells: int | None = None, **settings) -> DataFrame:
    """(candidate, weights, thresholds, valid_score) for (candidate, method, path, y_true, p); paths that lack a member are left out."""
    cols = [F.first(F.when(F.col("method") == m, F.col("p")), ignorenulls=True) for m in members]
    rows = (preds.where(F.col("method").isin(*members)).groupBy("candidate", "path").agg(F.first("y_true").alias("y"), F.array(*cols).alias("ps"))
            .where(~F.exists("ps", lambda p: p.isNull())).select("candidate", "path", "y", F.flatten("ps").alias("features"), F.lit(1.0).alias("weight")))
    found = fit_all(to_blocks(rows, cells) if cells else to_blocks(rows), WeightSearch(members, k, **settings))
    return preds.sparkSession.createDataFrame([(c, *pickle.loads(m)) for c, m in sorted(found.items())],
                                              "candidate int, weights array<double>, thresholds array<double>, valid_score double")
