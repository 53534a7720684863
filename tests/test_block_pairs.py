"""Block pairs of a cell that no tree splits: half of them in a self-join, blocks that grow with the cell, the same pairs."""

import numpy as np
import pandas as pd
import pytest

from assay.operators import dedup as dd
from tests.test_metric_tree import ORDERS, clouds, frame


class Met:
    """Tells how many left rows were met."""

    def __init__(self, left, right):
        self.n = len(left)

    def wanted(self, x, y):
        return np.zeros(len(x), dtype=bool)

    def result(self):
        return pd.DataFrame({"n": [self.n]})


@pytest.fixture(scope="module")
def unrelated(spark):
    x = clouds(240, 240, 0.0)
    x[200:] = x[:40][:, ORDERS[3]]  # turned copies
    return frame(spark, x[np.random.default_rng(1).permutation(240)])


def found(rows, strict):
    return sorted((r["a"], r["b"], round(r["corr"], 9), r["transform"], round(r["residual"], 9)) for r in dd.scored_pairs(rows, rows, 8, 0.5, True, strict).collect())


@pytest.mark.parametrize("strict", [False, True])
def test_same_pairs_as_in_one_block(unrelated, strict, monkeypatch):
    whole = found(unrelated, strict)
    assert len(whole) >= 40
    monkeypatch.setattr(dd, "CELL_ROWS", 20)
    monkeypatch.setattr(dd, "PRODUCT", 64)
    assert found(unrelated, strict) == whole
    monkeypatch.setattr(dd, "BLOCK_ROWS", 23)
    assert found(unrelated, strict) == whole


def test_rows_travel_to_few_blocks(unrelated, monkeypatch):
    monkeypatch.setattr(dd, "CELL_ROWS", 10)
    met = dd.joined_blocks(unrelated, unrelated, 8, 0.5, True, False, None, Met, "n long")
    # 24 blocks of 10 rows before, each pair of them a task
    assert met.agg({"n": "sum"}).first()[0] == 240 * 8 and met.rdd.count() == 64
