"""Histogram boosting against a learner that tries every cut of every node."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import boosting, heads
from assay.operators.boosting import Settings


def by_hand(x, y, w, k, s):
    """Posteriors of the rows themselves; no sampling of rows or columns."""
    f = np.zeros((len(x), k))

    def leaf(g, h):
        return -s.rate * np.sign(g) * max(abs(g) - s.l1, 0) / (h + s.l2)

    def gain(g, h):
        return max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)

    def grow(rows, g, h, depth, out):
        best = (1e-9, None)
        for j in range(x.shape[1]) if depth else ():
            for cut in np.unique(x[rows, j])[:-1]:
                left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                if min(h[left].sum(), h[right].sum()) >= s.min_child:
                    v = gain(g[left].sum(), h[left].sum()) + gain(g[right].sum(), h[right].sum()) - gain(g[rows].sum(), h[rows].sum())
                    if round(v, 9) > round(best[0], 9):
                        best = v, (left, right)
        if best[1] is None:
            out[rows] = leaf(g[rows].sum(), h[rows].sum())
        else:
            for part in best[1]:
                grow(part, g, h, depth - 1, out)

    for _ in range(s.rounds):
        p = boosting.softmax(f)
        step = np.zeros_like(f)
        for c in range(k):
            grow(np.arange(len(x)), (p[:, c] - (y == c)) * w, 2 * p[:, c] * (1 - p[:, c]) * w, s.depth, step[:, c])
        f += step
    return boosting.softmax(f)


def table(spark, x, y, w, candidate=0):
    return spark.createDataFrame([(candidate, f"r{i:03d}", int(b), [float(v) for v in a], float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))],
                                 "candidate int, path string, y int, features array<double>, weight double")


def example(seed, n=60, k=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    return x, (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 0.5), rng.choice([0.5, 1.0, 2.0], n)


@pytest.mark.parametrize("cells", [None, 80])
def test_same_as_every_cut(spark, cells, monkeypatch):
    """Also with rows in several blocks, where each sum is a job and scores are kept in between."""
    monkeypatch.setattr(boosting, "KEEP", 2)
    x, y, w = example(1)
    s = Settings(rounds=3 if cells else 25, depth=3, rate=0.3, rows=1.0, columns=1.0, min_child=1.0)
    rows = table(spark, x, y, w)
    got = boosting.boosted_posteriors(rows, rows, 3, s, cells).orderBy("path").toPandas()
    assert np.abs(np.stack(got["p"]) - by_hand(x, y, w, 3, s)).max() < 1e-5


def test_candidates_side_by_side(spark):
    """Fits of several candidates don't depend on each other; row and column samples don't depend on blocks."""
    s = Settings(rounds=2, depth=2, rate=0.3)
    a, b = table(spark, *example(2)), table(spark, *example(3, 40), candidate=5)
    both = {(r.candidate, r.path): r.p for r in boosting.boosted_posteriors(a.union(b), a.union(b), 3, s).collect()}
    for part in (a, b):
        for cells in (None, 64):
            alone = boosting.boosted_posteriors(part, part, 3, s, cells).collect()
            assert all(np.allclose(both[r.candidate, r.path], r.p, atol=1e-6) for r in alone)


def test_weights_and_learning(spark):
    """A row of weight three counts as three rows; the head separates what can be separated."""
    x, y, _ = example(4)
    times = np.arange(len(x)) % 3 + 1
    s = Settings(rounds=10, depth=3, rate=0.3, rows=1.0, columns=1.0)
    a = table(spark, x, y, times)
    b = table(spark, np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()))
    p, q = (boosting.boosted_posteriors(t, a, 3, s).orderBy("path").toPandas()["p"] for t in (a, b))
    assert np.allclose(np.stack(p), np.stack(q), atol=1e-6)
    rows = a.drop("candidate", "weight")
    weights = a.select("path", F.lit(1.0).alias("weight"))
    got = heads.boosted_trees_head(rows, rows, 3, rounds=150, depth=3, weights=weights, rate=0.1, min_child=0.5).toPandas()
    assert (np.stack(got["p"]).argmax(axis=1) == got["y"]).mean() > 0.9
