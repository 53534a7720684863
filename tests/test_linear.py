"""Batched linear learners and the weight search against single fits."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import ensemble, heads, linear, selection
from assay.operators.blocks import Block, Sums
from assay.plans import modelling
from tests.test_boosting import example, table


@pytest.mark.parametrize("cells", [None, 100])
def test_logistic_is_the_single_fit(spark, cells):
    x, y, _ = example(5)
    rows = table(spark, x, y, np.ones(len(x)))
    cs = [0.1, 1.5] if cells else [0.1, 1.5, 10.0]
    learner = linear.Logistic(3, cs, max_iter=12 if cells else 3000, tol=1e-3 if cells else 1e-7)
    got = linear.many_posteriors(rows, rows, learner, cells)
    if cells:  # the same passes as with one block
        other = linear.many_posteriors(rows, rows, learner)
    else:
        parts = [heads.logreg_head(rows, rows, 3, c=c).withColumn("c", F.lit(c)) for c in cs]
        other = parts[0].union(parts[1]).union(parts[2])
    a, b = ({(r.c, r.path): r.p for r in d.collect()} for d in (got, other))
    assert a.keys() == b.keys() and max(np.abs(np.array(a[i]) - b[i]).max() for i in a) < (1e-6 if cells else 5e-3)


def test_logistic_gradient_vanishes():
    x, y, w = example(6)
    block = Block(x, y.astype(np.int64), w, np.arange(len(y)))
    _, theta = pickle.loads(linear.Logistic(3, [0.7], balance=False, tol=1e-9)(Sums(block), 0))
    p = linear.softmax(linear.with_one(x) @ theta[0].T)
    p[np.arange(len(y)), y] -= 1
    g = (p * w[:, None]).T @ linear.with_one(x)
    g[:, :-1] += theta[0][:, :-1] / 0.7
    assert np.abs(g).max() < 1e-5


def svm_by_gradient(x, s, c, steps=20000):
    """Minimum of |w|² / 2 + sum c * max(0, 1 - s w x)²."""
    w = np.zeros(x.shape[1])
    rate = 1 / (1 + 2 * c.max() * np.linalg.norm(x, 2) ** 2)
    v = w
    for i in range(steps):
        new = v - rate * (v - 2 * ((c * s * np.maximum(0, 1 - s * (x @ v)))[:, None] * x).sum(axis=0))
        v, w = new + i / (i + 3) * (new - w), new
    return w


def test_svm_reaches_the_minimum(spark):
    x, y, w = example(7)
    svm = linear.LinearSvm(3, [0.1, 1.0], gap=1e-6)
    block = Block(x, y.astype(np.int64), w, np.arange(len(y)) * 7919)
    got, gaps, rounds = svm.fit(Sums(block))
    assert gaps.max() <= 1e-6 and rounds < 1000
    inside, sign = svm._inside(block.id), svm._signs(block.y)
    for m in (0, 4, 8, 9, 17):
        rows = ~inside[:, m]
        by_hand = svm_by_gradient(linear.with_one(x)[rows], sign[rows, m], np.repeat(svm.cs, 9)[m] * w[rows])
        assert np.abs(got[m] - by_hand).max() < 5e-3
    model = svm(Sums(Block(x, block.y, w, block.id)), 0)
    _, _, machines, slope, shift = pickle.loads(model)
    for m in (0, 4, 17):  # the sigmoid of a machine is the best one on the rows it hasn't seen
        own = inside[:, m]
        hit, margin = sign[own, m] > 0, linear.with_one(x)[own] @ machines[m]
        target = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))

        def loss(a, b):
            p = 1 / (1 + np.exp(a * margin + b))
            return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

        here = loss(slope[m], shift[m])
        assert all(here <= loss(slope[m] + i, shift[m] + j) + 1e-9 for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01))
    assert np.allclose(linear.LinearSvm.predict(model, x).reshape(len(x), 2, 3).sum(axis=2), 1)


def test_svm_over_blocks(spark):
    """Added updates of several blocks end at the same weights."""
    x, y, _ = example(8, 40, 2)
    rows = table(spark, x, y, np.ones(len(x)))
    svm = linear.LinearSvm(3, [0.1], gap=0.02, rounds=10)
    a, b = (linear.many_posteriors(rows, rows, svm, cells).orderBy("path").toPandas() for cells in (None, 90))
    assert np.abs(np.stack(a["p"]) - np.stack(b["p"])).max() < 0.1


def test_svm_head_runs_again_and_again(spark):
    rows = table(spark, *example(9)).drop("candidate", "weight")
    first = None
    for _ in range(3):
        got = {r.path: r.p for r in heads.linear_svm_head(rows, rows, 3).collect()}
        assert first in (None, got)
        first = got


@pytest.mark.parametrize("settings", [{}, {"metric": "accuracy"}, {"metric": "f1_macro", "min_recall": 0.6, "normal_idx": 1}])
def test_weight_search(spark, settings):
    """Against thresholds of the single search at every point; in one block or several."""
    rng = np.random.default_rng(11)
    members, k, n = ["a", "b", "xgboost"], 3, 50
    y = rng.integers(0, k, n)
    post = {m: linear.softmax(rng.normal(size=(n, k)) + s * np.eye(k)[y]) for m, s in zip(members, (0.5, 1.0, 1.5))}
    preds = spark.createDataFrame([(4, m, f"r{i}", int(y[i]), post[m][i].tolist()) for m in members for i in range(n)],
                                  "candidate int, method string, path string, y_true int, p array<double>")
    got, parts = (ensemble.weight_search(preds, members, k, cells, step=0.25, **settings).collect() for cells in (None, 90))
    assert got == parts and got[0].candidate == 4
    search = ensemble.WeightSearch(members, k, 0.25, **settings)
    at = int(np.abs(search.weights - got[0].weights).sum(axis=1).argmin())
    mix = sum(w * post[m] for w, m in zip(got[0].weights, members))
    d = spark.createDataFrame([(1, int(a), p.tolist()) for a, p in zip(y, mix)], "one int, y_true int, p array<double>")
    tuned = selection.tune_thresholds(d, ["one"], k, settings.get("metric", "bal_acc"), settings.get("min_recall", 0.0), settings.get("normal_idx"))
    assert [r.threshold for r in tuned.orderBy("cls").collect()] == got[0].thresholds
    if not settings:
        old = selection.ensemble_weight_search(preds.drop("candidate"), members, k, 0.25).first()
        assert old.valid_score == pytest.approx(got[0].valid_score) and (old.wid == -1) == (at == 0)


def test_baseline_that_fails_keeps_its_row(spark, monkeypatch):
    x, y, _ = example(12)
    rows = [("alpha", f"r{i}", int(b), "test" if i % 4 == 0 else "train", [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    f = spark.createDataFrame(rows, "backbone string, path string, y int, role string, features array<double>")

    def broken(*args, **kwargs):
        raise ArithmeticError("no such thing")

    monkeypatch.setitem(heads.HEADS, "rf", broken)
    table = [modelling.Baseline("good", "alpha", "logreg"), modelling.Baseline("bad", "alpha", "rf"), modelling.Baseline("absent", "beta", "logreg")]
    out, preds = modelling.baseline_table(f, table, 3, {"alpha": 4})
    got = {r.method: (r.status, r.accuracy is not None) for r in out.collect()}
    assert got == {"good": ("ok", True), "bad": ("failed: ArithmeticError: no such thing", False), "absent": ("missing blocks: beta", False)}
    assert preds.select("method").distinct().count() == 1


def test_svm_takes_few_passes():
    """Over the rows of several blocks; passes over the rows don't grow with them."""
    for n in (300, 6000):
        rng = np.random.default_rng(13)
        x, y = rng.normal(size=(n, 8)), rng.integers(0, 4, n)
        block, passes = Block(x, y.astype(np.int64), np.ones(n), np.arange(n) * 7919), []

        class Counted(Sums):
            def __call__(self, f):
                passes.append(f)
                return super().__call__(f)

        _, gaps, _ = linear.LinearSvm(4, [0.1, 10.0], gap=1e-6).fit(Counted(block))
        assert gaps.max() <= 1e-6 and len(passes) < 30


def test_single_weight_search_counts_rows_where_they_lie(spark):
    """Also with paths that lack a member, which take no part, and batches of a few rows; no row is multiplied by the points."""
    rng = np.random.default_rng(17)
    members, k, n = ["a", "b"], 3, 80
    y = rng.integers(0, k, n)
    post = {m: linear.softmax(rng.normal(size=(n, k)) + s * np.eye(k)[y]) for m, s in zip(members, (0.7, 1.2))}
    preds = spark.createDataFrame([(m, f"r{i}", int(y[i]), post[m][i].tolist()) for m in members for i in range(n)], "method string, path string, y_true int, p array<double>")
    whole = selection.ensemble_weight_search(preds, members, k).first()
    lone = spark.createDataFrame([("a", f"x{i}", i % k, [0.1, 0.1, 0.8]) for i in range(40)], preds.schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert selection.ensemble_weight_search(preds.unionByName(lone), members, k).first() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    block = Block(np.zeros((10**5, 6)), np.zeros(10**5, dtype=np.int64), np.ones(10**5), np.zeros(10**5, dtype=np.int64))
    assert max(len(x) for x, _ in ensemble.pieces(block, 67, k)) * 67 * k <= ensemble.AT_ONCE
