"""Learners of the grid run side by side, over one copy of the train rows in blocks."""

from threading import Barrier

import pytest
from pyspark.sql import functions as F

from assay.operators import blocks
from assay.plans import modelling


def test_learners_are_fitted_at_the_same_time(spark, monkeypatch):
    """Two meet here; one after the other, the first would wait in vain."""
    both, made = Barrier(2), []

    class Met(Exception):
        pass

    def posteriors(train, valid, learner, kwargs, groups, cs, k, own):
        made.append(own)
        both.wait(60)
        raise Met

    copies = []
    monkeypatch.setattr(modelling, "grid_posteriors", posteriors)
    monkeypatch.setattr(modelling, "to_blocks", lambda rows: copies.append(0) or blocks.to_blocks(rows), raising=False)
    d = spark.range(8).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("a").alias("backbone"), F.when(F.col("id") < 4, "train").otherwise("valid").alias("role"),
                              F.array(F.col("id").cast("double")).alias("features"), (F.col("id") % 2).cast("int").alias("y"))
    with pytest.raises(Met):
        modelling.grid_selection(d, ["a"], {"logreg": {}, "gbt": {"rounds": 1}}, [0.0], [1.0], 2)
    assert copies == [0] and made[0] is made[1]


def test_same_grid_as_one_by_one(spark):
    """Scores of each learner don't depend on what runs beside it."""
    d = spark.range(60).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("a").alias("backbone"), F.when(F.col("id") % 3 > 0, "train").otherwise("valid").alias("role"),
                               F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("features"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    learners = {"logreg": {}, "knn": {"neighbours": 3}, "gbt": {"rounds": 5, "depth": 2, "min_child": 0.5}}
    key = lambda g: {(r.learner, r.c): (r.valid_acc, r.valid_f1, r.temperature) for r in g.collect() if r.learner != "ens"}
    together = key(modelling.grid_selection(d, ["a"], learners, [0.0], [0.5, 2.0], 2))
    alone = {}
    for name, kwargs in learners.items():
        alone |= key(modelling.grid_selection(d, ["a"], {name: kwargs}, [0.0], [0.5, 2.0], 2))
    assert together == alone and len(together) == 4
