"""Exact top-k search against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import topk


def by_hand(rows, is_query, k):
    ok = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    queries = {(i, tuple(v)) for i, v in ok if is_query(i)}
    out = []
    for i, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j or 0) for j, x in ok if j != i and len(x) == len(q))
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("seed", [0, 1])
def test_random(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_CELLS", 64)
    monkeypatch.setattr(topk, "CHUNK_CELLS", 128)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 9))
    rows = [(i, np.round(centres[i % 4] + rng.normal(size=9) / 10, 1).tolist()) for i in range(200)]
    rows += rows[:30] + [(i, [0.5] * 9) for i in range(200, 240)]  # repeated rows, equal scores
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(topk.exact_top_k(df, F.col("vec_id") % 5 == 0, 7)) == by_hand(rows, lambda i: i % 5 == 0, 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.5]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [3.0]), (40, [1.0]),
            (None, [1.0, 2.0]), (None, [9.0, 9.0]), (7, [1.0, 2.0]), (60, None), (80, [1e12, 3.0]), (81, [-2.5e12, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "id": F.lit(2), "block": F.lit(3)})
    assert got(topk.exact_top_k(df, F.col("vec_id") % 20 == 0, 3)) == [
        (i, r, j, (s + 2 ** 63) % 2 ** 64 - 2 ** 63) for i, r, j, s in by_hand(rows, lambda i: i is not None and i % 20 == 0, 3)]
    assert got(topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0)) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    q, x = rng.integers(-64, 64, (40, 37)), rng.integers(-64, 64, (500, 37))
    bounds = [r.features(q.astype(float)) @ r.features(x.astype(float)).T for r in (topk.Resolution(37, n) for n in topk.SEGMENTS)]
    for b in bounds:
        assert (b + 1e-6 >= q @ x.T).all()
    smooth = np.cumsum(rng.normal(size=(6000, 64)), axis=1)
    smooth = np.floor(64 * smooth / np.linalg.norm(smooth, axis=1)[:, None]).astype(np.int64)
    block = topk.Block(list(range(20)), smooth[:20], 20)
    block.meet(list(range(len(smooth))), smooth)
    assert block.exact < 0.2 * 20 * len(smooth)  # candidates of the first chunk have no bound to meet
