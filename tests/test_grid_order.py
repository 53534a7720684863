"""The grid's work is dealt so that no fit is waited for longer than it takes."""

import struct
from threading import Barrier

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from assay.operators import blocks, boosting, features
from assay.operators.blocks import Block, Sums
from assay.plans import modelling


def test_largest_fit_begins_first(spark):
    """Tasks begin in their order; before, the order was that of the candidates' numbers."""
    widths = {0: 2, 1: 9, 2: 5}
    rows = [(c, f"r{i}", 0, [float(i)] * w, 1.0) for c, w in widths.items() for i in range(8)]
    table = spark.createDataFrame(rows, "candidate int, path string, y int, features array<double>, weight double")
    got = blocks.fit_all(blocks.to_blocks(table), lambda sums, candidate: struct.pack("q", TaskContext.get().partitionId()))
    assert sorted(got, key=lambda c: struct.unpack("q", got[c])[0]) == [1, 2, 0]


def test_histograms_hold_drawn_features_only():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 10))
    block = Block(x, (x[:, 0] > 0).astype(np.int64), np.ones(300), np.arange(300))
    seen = []

    class Spy(Sums):
        def __call__(self, f):
            seen.append(super().__call__(f))
            return seen[-1]

    edges = [np.quantile(c, np.arange(1, 30) / 30) for c in x.T]
    s = boosting.Settings(rounds=2, depth=3, columns=0.3, rate=0.3)
    model = boosting.Boosting({0: edges}, 2, s)(Spy(block), 0)
    assert {h.shape[-1] for h in seen} == {3}
    assert (boosting.predict(model, x).argmax(axis=1) == block.y).mean() > 0.5


def test_representations_are_fitted_at_the_same_time(spark, monkeypatch):
    """Two meet here; one after the other, the first would wait in vain. Decompositions stay alone."""
    both = Barrier(2)

    class Met(Exception):
        pass

    def prepared(*_):
        both.wait(60)
        raise Met

    monkeypatch.setattr(modelling, "prepared", prepared)
    d = spark.range(4).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("a").alias("backbone"), F.lit("train").alias("role"),
                              F.array(F.col("id").cast("double")).alias("features"), F.lit(0).alias("y"))
    with pytest.raises(Met):
        modelling.grid_selection(d, ["a"], {"knn": {}}, [0.0, 0.95], [1.0], 2)
    alone = []
    monkeypatch.setattr(features, "PCA", lambda **_: alone.append(features.PCA_ALONE.locked()))
    with pytest.raises(AttributeError):
        features.fit_representation(spark.createDataFrame([([0.0, 1.0],), ([1.0, 3.0],)], "features array<double>"), pca_variance=0.9)
    assert alone == [True] and not features.PCA_ALONE.locked()
