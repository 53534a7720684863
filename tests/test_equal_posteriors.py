"""Figures over many equal posteriors are taken from each posterior once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import selection


def test_temperature_of_repeated_rows(spark, monkeypatch):
    """The same temperature as by a search over the rows, and no pass over the rows after the first."""
    rng = np.random.default_rng(3)
    base = rng.dirichlet(np.ones(3), 12)
    rows = [("a", int(rng.integers(3)), base[i % 12].tolist()) for i in range(600)]
    sizes = []
    real = selection.write_and_read
    monkeypatch.setattr(selection, "write_and_read", lambda d, name: sizes.append((out := real(d, name)).count()) or out)
    got = selection.temperature_fit(spark.createDataFrame(rows, "method string, y_true int, p array<double>"), ["method"]).first()
    assert len(sizes) == 1 and sizes[0] <= 36
    log = np.log(np.maximum(1e-12, np.array([r[2] for r in rows])))
    y = np.array([r[1] for r in rows])

    def loss(t):
        z = log / t
        z = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
        return -z[np.arange(len(y)), y].mean()

    assert got.nll == pytest.approx(loss(got.temperature), abs=1e-9)
    assert loss(got.temperature) <= min(loss(t) for t in np.exp(np.linspace(np.log(0.05), np.log(20), 2000))) + 1e-6


def test_rules_of_counted_posteriors(spark):
    rng = np.random.default_rng(4)
    base = rng.dirichlet(np.ones(4), 9)
    d = spark.createDataFrame([("a", f"r{i}", i % 4, base[i % 9].tolist()) for i in range(90)], "method string, path string, y_true int, p array<double>")
    settings = ([0.3, 0.4, 0.5, 0.6], 4, 0, 1.5)
    by_row = selection.decision_rules(d, *settings).groupBy("rule", "decision").agg(F.count(F.lit(1)).alias("n"))
    counted = selection.distinct_posteriors(d, ["method"])
    assert counted.count() == 9
    by_posterior = selection.decision_rules(counted, *settings, ("n",)).groupBy("rule", "decision").agg(F.sum("n").alias("n"))
    assert sorted(by_row.collect()) == sorted(by_posterior.collect())
