"""Model queries are registered over the published settings, not over a smaller job."""

import inspect

from assay.operators import heads
from assay.plans import catalog, feature_queries as fq, fixtures as fx, modelling as mo


class Stop(Exception):
    pass


def asked(monkeypatch, module, function, name):
    """The arguments that the query gives to a function."""
    signature, got = inspect.signature(getattr(module, function)), []

    def instead(*args, **kwargs):
        got.append(signature.bind(*args, **kwargs))
        got[0].apply_defaults()
        raise Stop

    monkeypatch.setattr(module, function, instead)
    monkeypatch.setattr(fx, "features", lambda spark, sf: None)
    monkeypatch.setattr(fq, "_split", lambda spark, sf: (None, None))
    try:
        catalog.queries()[name](None, "")
    except Stop:
        pass
    return got[0].arguments


def test_grid(monkeypatch):
    got = asked(monkeypatch, mo, "grid_selection", "grid_selection")
    assert len({frozenset(s.split("+")) for s in got["specs"]}) == 7 and set(got["learners"]) == {"logreg", "knn", "rbf", "gbt", "linsvm"} and got["ensemble"]
    assert got["pcas"] == [0.0, 0.95] and got["cs"] == [0.1, 1.5, 10.0]
    assert got["learners"]["gbt"] == {"rounds": 1200, "depth": 6}


def test_boosting(monkeypatch):
    assert asked(monkeypatch, heads, "fit_head", "boosted_trees_head")["kwargs"] == {"rounds": 1200, "depth": 6}


def test_iteration_limits(spark, monkeypatch):
    rows = spark.createDataFrame([(str(i), i % 2, "train", [float(i), float(i * i % 5)]) for i in range(12)],
                                 "path string, y int, role string, features array<double>")
    monkeypatch.setattr(fq, "_fused", lambda spark, sf: rows)
    monkeypatch.setattr(fq, "_cv_folds", lambda d: d)
    assert not asked(monkeypatch, mo, "cv_evaluate", "cv_evaluate")["kwargs"]
    assert asked(monkeypatch, heads, "logreg_model", "save_pipeline_artifact")["max_iter"] == 3000
