"""The k nearest of a block without a full sort, and rows that leave Python once."""

import numpy as np
import pytest

from assay.operators import heads


@pytest.mark.parametrize("shape, k", [((60, 400), 5), ((7, 5), 5), ((7, 3), 5), ((9, 6), 5), ((20, 50), 1)])
def test_as_a_stable_sort_of_all(shape, k):
    """With exact ties, ties that only rounding makes, and values that rounding errors took below 0."""
    rng = np.random.default_rng(5)
    for step, noise in ((1.0, 0.0), (1e-9, 4e-10), (1e-9, 1e-9), (0.1, 0.3)):
        d = rng.integers(-1, 6, shape) * step + rng.uniform(-noise, noise, shape)
        r = np.round(np.maximum(d, 0.0), 9)
        top = np.argsort(r, axis=1, kind="stable")[:, :k]
        i, j = heads.nearest(d, k)
        assert i.tolist() == np.repeat(np.arange(len(d)), top.shape[1]).tolist() and j.tolist() == top.ravel().tolist()


def test_python_returns_a_row_once(spark, monkeypatch):
    """Rows to score go to many cells here; before, Python made the copies."""
    monkeypatch.setattr(heads, "KNN_BLOCK", 8)
    rng = np.random.default_rng(6)
    make = lambda p, n: spark.createDataFrame([(f"{p}{i:03d}", 0, x.tolist()) for i, x in enumerate(rng.normal(size=(n, 16)))], "path string, y int, features array<double>")
    train, evalu = make("t", 200), make("e", 40)
    x, z = (np.array([r["features"] for r in d.orderBy("path").collect()]) for d in (train, evalu))
    kind = type(train)
    made, real = [], kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, schema, *rest, **more: made.append((schema, real(self, f, schema, *rest, **more))) or made[-1][1])
    got = {(r["path"], r["rank"]): r["neighbour"] for r in heads.nearest_neighbours(train, evalu, 5).collect()}
    want = np.argsort(np.round(((z[:, None, :] - x[None]) ** 2).sum(2), 9), axis=1, kind="stable")[:, :5]
    assert got == {(f"e{i:03d}", r + 1): f"t{j:03d}" for i, row in enumerate(want) for r, j in enumerate(row)}
    visits = [d for schema, d in made if "pd double" not in schema]
    assert len(visits) == 1 and visits[0].count() == 40
