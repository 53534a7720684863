"""Forests grown in tasks: one tree against a learner that tries every cut, and the shared work against all trees in one place."""

import numpy as np
import pytest

from assay.operators import forest, heads
from assay.operators.blocks import Block, to_blocks
from assay.operators.boosting import binned, edges_of
from tests.test_boosting import example, table


def gini(w, y, rows, k):
    n = np.bincount(y[rows], w[rows], k)
    return n.sum() - (n ** 2).sum() / max(n.sum(), 1)


def by_hand(x, y, w, rows, k, min_leaf, out):
    best = (1e-9, None)
    for j in range(x.shape[1]):
        for cut in np.unique(x[rows, j])[:-1]:
            left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
            if min(w[left].sum(), w[right].sum()) >= min_leaf:
                fall = gini(w, y, rows, k) - gini(w, y, left, k) - gini(w, y, right, k)
                if fall > best[0] + 1e-9:
                    best = fall, (left, right)
    if best[1] is None:
        out[rows] = np.bincount(y[rows], w[rows], k) / w[rows].sum()
    else:
        for part in best[1]:
            by_hand(x, y, w, part, k, min_leaf, out)


@pytest.mark.parametrize("min_leaf, cells", [(1, forest.CELLS), (1, 1), (4, forest.CELLS)])
def test_tree_tries_every_cut(min_leaf, cells, monkeypatch):
    monkeypatch.setattr(forest, "CELLS", cells)  # with 1 each node has its own histogram
    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 20, (90, 4)).astype(np.uint8), rng.integers(0, 3, 90), rng.poisson(1.0, 90).astype(float)
    tree = forest.grow(x, y, w, 3, 4, 30, min_leaf, np.random.default_rng(0))
    seen, want = np.flatnonzero(w), np.zeros((90, 3))
    by_hand(x, y, w, seen, 3, min_leaf, want)
    assert np.allclose(forest.shares(tree, x)[seen], want[seen], atol=1e-6)


def test_depth_is_a_limit():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 20, (90, 4)).astype(np.uint8), rng.integers(0, 3, 90)
    assert len(forest.grow(x, y, np.ones(90), 3, 4, 2, 1, np.random.default_rng(0))[0]) <= 7


def test_dealt_trees_are_all_counted(spark, monkeypatch):
    """19 trees in groups of 8, rows to score in several batches."""
    monkeypatch.setattr(forest, "SCORED", 16)
    x, y, w = example(5)
    train = table(spark, x, y, np.ones(len(y)))
    got = {r["path"]: r["p"] for r in heads.random_forest_head(train, train, 3, trees=19).collect()}
    b = Block.of(to_blocks(train).first().asDict())
    edges = edges_of(train, forest.BINS)[0]
    at, every, want = binned(b.x, edges), binned(x, edges), 0
    for t in range(19):
        rng = np.random.default_rng([42, t])
        want = want + forest.shares(forest.grow(at, b.y, rng.poisson(1.0, len(at)).astype(float), 3, 2, 30, 1, rng), every)
    assert np.allclose([got[f"r{i:03d}"] for i in range(len(x))], want / 19)
