"""Linear learners over matrix blocks: many logistic regressions or support vector machines in the same passes.

``Logistic`` minimises the multinomial loss of all penalties together: a pass returns value and gradient
of each candidate at its own trial point, candidates step and stop by themselves. ``LinearSvm`` takes
Newton steps for all (penalty, fold, class) machines together: a pass returns value, gradient and curvature
of each, and a machine stops when its duality gap is small.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.blocks import Block, Sums, fit_all, posteriors, to_blocks


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


class _Mapped:
    """A block seen through a feature map."""

    def __init__(self, feature_map, f):
        self.feature_map, self.f = feature_map, f

    def __call__(self, block: Block) -> np.ndarray:
        if block.memo is None:
            block.memo = Block(self.feature_map(block.x), block.y, block.w, block.id)
        return self.f(block.memo)


class Fourier:
    """Random features whose inner product approximates exp(-gamma |x - y|²)."""

    def __init__(self, width: int, gamma: float, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w, self.b = rng.normal(0.0, np.sqrt(2 * gamma), (width, size)), rng.uniform(0.0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.w + self.b)


def _class_weights(sums: Sums, k: int, balance: bool) -> np.ndarray:
    total = sums(lambda b: np.bincount(b.y, b.w, k))
    return total.sum() / (k * np.maximum(total, 1e-300)) if balance else np.ones(k)


class Logistic:
    """Multinomial logistic regression for each C of ``cs``: sum of weighted losses + |w|² / (2 C), intercepts free.

    ``fourier`` (size, seed) puts random features of gamma = 1 / (width * variance) in front.
    """

    def __init__(self, k: int, cs: list[float], balance: bool = True, max_iter: int = 3000, tol: float = 1e-4, fourier: tuple[int, int] | None = None):
        self.k, self.cs, self.balance, self.max_iter, self.tol, self.fourier = k, np.array(cs, dtype=float), balance, max_iter, tol, fourier

    def __call__(self, sums: Sums, candidate: int) -> bytes:
        k, cs = self.k, self.cs
        weight = _class_weights(sums, k, self.balance)
        feature_map = None
        if self.fourier:
            n, s1, s2 = sums(lambda b: np.array([b.x.size, b.x.sum(), (b.x ** 2).sum()]))
            variance = s2 / n - (s1 / n) ** 2
            width = int(sums(lambda b: np.array([b.x.shape[1] * len(b.y), len(b.y)])) @ [1, 0] / sums(lambda b: np.array([len(b.y)]))[0])
            feature_map = Fourier(width, 1 / (width * variance) if variance > 0 else 1.0, *self.fourier)
        through = (lambda f: sums(_Mapped(feature_map, f))) if feature_map else sums
        size = through(lambda b: np.array([float(b.x.shape[1] * len(b.y)), float(len(b.y)), float((b.w * weight[b.y]).sum())]))
        dim, total = int(size[0] / size[1]), size[2]
        shape = (len(cs), k, dim + 1)

        def value_and_gradient(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def part(b: Block) -> np.ndarray:
                x, w = with_one(b.x), (b.w * weight[b.y])
                z = (x @ theta.reshape(-1, dim + 1).T).reshape(len(x), len(cs), k).transpose(1, 0, 2)
                p = softmax(z)
                loss = -(np.log(np.maximum(p[:, np.arange(len(b.y)), b.y], 1e-300)) * w).sum(axis=1)
                p[:, np.arange(len(b.y)), b.y] -= 1
                g = (p * w[None, :, None]).transpose(1, 0, 2).reshape(len(x), -1).T @ x
                return np.concatenate([loss[:, None], g.reshape(len(cs), -1)], axis=1)

            r = through(part)
            f, g = r[:, 0], r[:, 1:].reshape(shape)
            f = f + (theta[:, :, :-1] ** 2).sum(axis=(1, 2)) / (2 * cs)
            g[:, :, :-1] += theta[:, :, :-1] / cs[:, None, None]
            return f / total, g.reshape(len(cs), -1) / total

        theta = _minimise(lambda t: value_and_gradient(t.reshape(shape)), np.zeros((len(cs), k * (dim + 1))), self.max_iter, self.tol)
        return pickle.dumps((feature_map, theta.reshape(shape)))

    @staticmethod
    def predict(model: bytes, x: np.ndarray) -> np.ndarray:
        """Posteriors of all penalties, side by side."""
        feature_map, theta = pickle.loads(model)
        z = np.einsum("nd,mkd->nmk", with_one(feature_map(x) if feature_map else x), theta)
        return softmax(z).reshape(len(x), -1)


def _minimise(evaluate, theta: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps for each row of ``theta``; a row stops when its largest gradient is below ``tol``."""
    f, g = evaluate(theta)
    history: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        live = np.abs(g).max(axis=1) > tol
        if not live.any():
            break
        q, alphas = g.copy(), []
        for s, y, rho in reversed(history):
            a = rho * (s * q).sum(axis=1)
            q -= a[:, None] * y
            alphas.append(a)
        if history:
            s, y, _ = history[-1]
            yy = (y * y).sum(axis=1)
            q *= np.where(yy > 0, (s * y).sum(axis=1) / np.where(yy > 0, yy, 1), 1.0)[:, None]
        for (s, y, rho), a in zip(history, reversed(alphas)):
            q += (a - rho * (y * q).sum(axis=1))[:, None] * s
        slope = -(q * g).sum(axis=1)
        bad = slope >= 0
        q[bad], slope[bad] = g[bad], -(g[bad] ** 2).sum(axis=1)
        step = np.where(live, 1.0, 0.0) if history else np.where(live, 1 / np.maximum(np.abs(g).sum(axis=1), 1e-300), 0.0)
        for _ in range(40):
            new = theta - step[:, None] * q
            nf, ng = evaluate(new)
            fails = live & ~(nf <= f + 1e-4 * step * slope)
            if not fails.any():
                break
            step = np.where(fails, step / 2, step)
        else:
            step = np.where(fails, 0.0, step)
            new = theta - step[:, None] * q
            nf, ng = evaluate(new)
        s, y = new - theta, ng - g
        sy = (s * y).sum(axis=1)
        ok = sy > 1e-14
        history = [*history, (s * ok[:, None], y * ok[:, None], np.where(ok, 1 / np.where(ok, sy, 1), 0.0))][-memory:]
        if not (step > 0).any():
            break
        theta, f, g = new, nf, ng
    return theta


class LinearSvm:
    """Machines with squared hinge loss, one against the rest, for each C, on the rows outside each of ``folds`` folds; margins on
    the fold's rows get a sigmoid, and posteriors are the folds' mean of normalised sigmoids.

    The intercept is a constant feature and is penalised like the others. ``gap`` is the relative duality gap at which all stop.
    """

    def __init__(self, k: int, cs: list[float], folds: int = 3, gap: float = 1e-3, rounds: int = 1000):
        self.k, self.cs, self.folds, self.gap, self.rounds = k, np.array(cs, dtype=float), folds, gap, rounds

    def _signs(self, y: np.ndarray) -> np.ndarray:
        """(rows, machines): +1, -1; machines are (C, fold, class)."""
        return np.tile(np.where(y[:, None] == np.arange(self.k), 1.0, -1.0), (1, len(self.cs) * self.folds))

    def _inside(self, ids: np.ndarray) -> np.ndarray:
        """Is the row in the machine's fold?"""
        fold = (ids.view(np.uint64) % np.uint64(self.folds)).astype(int)
        return np.tile(np.repeat(fold[:, None] == np.arange(self.folds), self.k, axis=1), (1, len(self.cs)))

    def fit(self, sums: Sums) -> tuple[np.ndarray, np.ndarray, int]:
        """(weights, relative gaps, rounds)."""
        penalty = np.repeat(self.cs, self.folds * self.k)
        n, cells = sums(lambda b: np.array([len(b.y), b.x.shape[1] * len(b.y)]))
        dim = int(cells) // int(n) + 1
        w = np.zeros((len(penalty), dim))

        def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Value, relative gap, gradient and curvature of each machine."""
            r, size = sums(_Newton(self, w, penalty)), (w ** 2).sum(axis=1) / 2
            pull = r[:, 2:2 + dim]  # the weights that belong to the duals 2 c slack
            primal, dual = size + r[:, 0], r[:, 1] - (pull ** 2).sum(axis=1) / 2
            return primal, (primal - dual) / np.maximum(1.0, np.abs(primal)), w - pull, np.eye(dim) + r[:, 2 + dim:].reshape(-1, dim, dim)

        now = at(w)
        for turn in range(self.rounds):
            value, gaps, gradient, curvature = now
            live = gaps > self.gap
            if not live.any():
                return w, gaps, turn
            step = np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
            slope, size = (step * gradient).sum(axis=1), live.astype(float)
            for _ in range(40):
                new = w - size[:, None] * step
                then = at(new)
                fails = live & ~(then[0] <= value - 1e-4 * size * slope)
                if not fails.any():
                    break
                size = np.where(fails, size / 2, size)
            if (fails | ~live).all():  # no machine gets lower in these numbers
                return w, gaps, turn
            w = np.where(fails[:, None], w, new)
            now = tuple(np.where(fails.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in zip(now, then))
        return w, now[1], self.rounds

    def __call__(self, sums: Sums, candidate: int) -> bytes:
        w, gaps, _ = self.fit(sums)
        positive, negative = sums(lambda b: np.stack([((self._signs(b.y) == s) & self._inside(b.id)).sum(axis=0).astype(float) for s in (1, -1)]))
        high, low = (positive + 1) / (positive + 2), 1 / (negative + 2)
        a, b0 = np.zeros(len(w)), np.log((negative + 1) / (positive + 1))
        for _ in range(100):  # Newton steps of all sigmoids
            r = sums(_Sigmoids(self, w, a, b0, high, low))
            g1, g2, h11, h22, h21 = r
            if np.maximum(np.abs(g1), np.abs(g2)).max() < 1e-6:
                break
            h11, h22 = h11 + 1e-9, h22 + 1e-9
            det = h11 * h22 - h21 ** 2
            da, db = -(h22 * g1 - h21 * g2) / det, -(h11 * g2 - h21 * g1) / det
            limit = np.minimum(1.0, 5 / np.maximum(np.abs(da) + np.abs(db), 1e-300))
            a, b0 = a + limit * da, b0 + limit * db
        return pickle.dumps((self.k, self.folds, w, a, b0))

    @staticmethod
    def predict(model: bytes, x: np.ndarray) -> np.ndarray:
        k, folds, w, a, b = pickle.loads(model)
        s = 1 / (1 + np.exp(np.clip(a * (with_one(x) @ w.T) + b, -500, 500)))
        s = s.reshape(len(x), -1, folds, k)
        total = s.sum(axis=3, keepdims=True)
        return np.where(total > 0, s / np.where(total > 0, total, 1), 1 / k).mean(axis=2).reshape(len(x), -1)


class _Newton:
    """For each machine: loss, the dual's linear and quadratic part at the duals 2 c slack, the weights of these duals, and the
    curvature of the loss."""

    #: rows worked on at once
    ROWS = 4096

    def __init__(self, svm: LinearSvm, w: np.ndarray, penalty: np.ndarray):
        self.svm, self.w, self.penalty = svm, w, penalty

    def __call__(self, block: Block) -> np.ndarray:
        machines, dim = self.w.shape
        out = np.zeros((machines, 2 + dim + dim * dim))
        for lo in range(0, len(block.y), self.ROWS):
            rows = slice(lo, lo + self.ROWS)
            x, sign = with_one(block.x[rows]), self.svm._signs(block.y[rows])
            c = np.where(self.svm._inside(block.id[rows]), 0.0, self.penalty[None, :] * np.maximum(block.w[rows], 1e-12)[:, None])
            slack = np.maximum(0.0, 1 - sign * (x @ self.w.T))
            alpha = 2 * c * slack
            out[:, 0] += (c * slack ** 2).sum(axis=0)
            out[:, 1] += (alpha - alpha * slack / 2).sum(axis=0)
            out[:, 2:2 + dim] += (alpha * sign).T @ x
            bend = 2 * c * (slack > 0)
            for m in range(machines):
                own = bend[:, m] > 0
                part = x[own]
                out[m, 2 + dim:] += ((part * bend[own, m][:, None]).T @ part).ravel()
        return out


class _Sigmoids:
    """Gradient and curvature of the sigmoids' loss on the rows of each machine's fold."""

    def __init__(self, svm, w, a, b, high, low):
        self.svm, self.w, self.a, self.b, self.high, self.low = svm, w, a, b, high, low

    def __call__(self, block: Block) -> np.ndarray:
        inside = self.svm._inside(block.id)
        m = with_one(block.x) @ self.w.T
        t = np.where(self.svm._signs(block.y) > 0, self.high, self.low)
        p = 1 / (1 + np.exp(np.clip(self.a * m + self.b, -500, 500)))
        d1, d2 = np.where(inside, t - p, 0.0), np.where(inside, p * (1 - p), 0.0)
        return np.stack([(m * d1).sum(axis=0), d1.sum(axis=0), (m * m * d2).sum(axis=0), d2.sum(axis=0), (m * d2).sum(axis=0)])


def many_posteriors(train: DataFrame, evalu: DataFrame, learner: Logistic | LinearSvm, cells: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(candidate, c, path, y, p): posteriors of each candidate and penalty. ``train`` is (candidate, path, y, features, weight),
    ``blocks`` the same in blocks, if they are there."""
    if blocks is None:
        blocks = to_blocks(train, cells) if cells else to_blocks(train)
    flat = posteriors(evalu, fit_all(blocks, learner), learner.predict)
    k = learner.k
    each = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.slice("p", i * k + 1, k).alias("p")) for i, c in enumerate(learner.cs)])
    return flat.select("candidate", "path", "y", F.explode(each).alias("e")).select("candidate", "e.c", "path", "y", "e.p")
