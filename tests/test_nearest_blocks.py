"""The k nearest of a block pair: only the least of column groups are ordered, not all distances."""

import numpy as np

from assay.operators import heads


def test_orders_column_groups_only(monkeypatch):
    widths, real = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **more: widths.append(a.shape[1]) or real(a, *rest, **more))
    rng = np.random.default_rng(8)
    for d in (rng.normal(size=(20, 3001)) ** 2, np.zeros((4, 1000)), np.sort(rng.random((6, 2500)), axis=1)[:, ::-1]):
        top = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :5]
        i, j = heads.nearest(d, 5)
        assert j.tolist() == top.ravel().tolist() and i.tolist() == np.repeat(np.arange(len(d)), 5).tolist()
    assert max(widths) <= 160  # before, all columns
