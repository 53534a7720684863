"""A large candidate's rounds are dealt over tasks by class; the trees are those of a whole fit."""

import numpy as np
import pytest

from assay.operators import blocks, boosting
from assay.operators.blocks import Block, Sums
from assay.operators.boosting import Settings
from tests.test_boosting import example, table


def test_shares():
    """Each class of each candidate once, equal work, few candidates in a task."""
    got = boosting.dealt({0: 640}, 10, 8)
    assert sorted(c for _, _, classes in got for c in classes) == list(range(10)) and len({t for t, _, _ in got}) == 8
    got = boosting.dealt({4: 64, 7: 32, 9: 16}, 10, 4)
    assert sorted((c, x) for _, c, classes in got for x in classes) == [(c, x) for c in (4, 7, 9) for x in range(10)]
    work = [sum({4: 64, 7: 32, 9: 16}[c] * len(classes) for t, c, classes in got if t == task) for task in range(4)]
    assert max(work) - min(work) <= 64 and len(got) <= 4 + 2


def test_rounds_over_tasks(spark, monkeypatch):
    """Also beyond the rounds that are told as a broadcast, and beside a candidate of several blocks."""
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "SHARED", 0)
    s = Settings(rounds=5, depth=3, rate=0.3, min_child=0.5)
    rows = table(spark, *example(6)).union(table(spark, *example(7, 40), candidate=3))
    for cells in (None, 200):
        made = blocks.to_blocks(rows, cells) if cells else blocks.to_blocks(rows)
        learner = boosting.Boosting(boosting.edges_of(rows, s.bins), 3, s)
        seen = []

        def spy(blocks, sizes, *rest, f=boosting.grow_together):
            seen.append((sorted(sizes), rest[-1]))
            return f(blocks, sizes, *rest)

        with monkeypatch.context() as m:
            m.setattr(boosting, "grow_together", spy)
            m.setattr(boosting, "fit_all", blocks.fit_all if cells else None)
            got = boosting.fit(made, learner)
        assert seen == [([3] if cells else [0, 3], 3 if cells else 6)]
        for c, x in ((0, example(6)[0]), (3, example(7, 40)[0])):
            whole = blocks.fit_all(made, learner)[c]
            assert np.array_equal(boosting.predict(got[c], x), boosting.predict(whole, x))


@pytest.mark.parametrize("depth", [3, 9])
def test_counted_by_feature_or_at_once(monkeypatch, depth):
    """Both ways of counting give the same trees; a deep tree has more nodes than a byte can number."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    block = lambda: Block(x, (x[:, 0] + x[:, 1] > 0).astype(np.int64), np.ones(900), np.arange(900))
    learner = boosting.Boosting({0: [np.quantile(c, np.arange(1, 100) / 100) for c in x.T]}, 2, Settings(rounds=4, depth=depth, rate=0.3, min_child=0.2, l1=0.0))
    some = boosting.predict(learner(Sums(block()), 0), x)
    monkeypatch.setattr(boosting, "FEW", 0)
    assert np.abs(boosting.predict(learner(Sums(block()), 0), x) - some).max() < 1e-6
    assert (some.argmax(axis=1) == block().y).mean() > 0.8
