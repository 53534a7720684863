"""The split tree of the near-duplicate join: no pair lost, comparisons that grow below the square."""

import numpy as np
import pytest

from assay.functions.vectors import scan_orders
from assay.operators import dedup as dd, metric_tree as mt

ORDERS = scan_orders(8)


def units(x):
    x = x - x.mean(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clouds(n, clusters, noise, seed=5):
    """Rows around centres, each turned at random."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(clusters, 64))
    x = base[rng.integers(clusters, size=n)] + noise * rng.normal(size=(n, 64))
    return units(np.stack([v[ORDERS[rng.integers(8)]] for v in x]))


def best(u, w):
    return np.max([u @ w[:, o].T for o in ORDERS], axis=0)


@pytest.mark.parametrize("t", [0.9995, 0.98, 0.9])
def test_every_pair_meets_in_the_left_row_s_leaf(t):
    a, b = clouds(600, 20, 0.15), clouds(500, 20, 0.15, seed=6)
    b[:50] = a[:50][:, ORDERS[3]]  # copies that are turned
    reach = mt.reach_of(t)
    tree = mt.grow(a, b, len(a), len(b), 8, reach, 16, 0)
    assert len(tree["cut"]) > 3
    rows, leaves = mt.route(a, tree, 8, reach, False)
    assert sorted(rows.tolist()) == list(range(len(a)))
    home = dict(zip(rows.tolist(), leaves.tolist()))
    seen = set(zip(*(x.tolist() for x in mt.route(b, tree, 8, reach, True))))
    x, y = np.nonzero(best(a, b) >= t - 1e-12)
    assert len(x) >= 50
    assert all((j, home[i]) in seen for i, j in zip(x.tolist(), y.tolist()))


def test_a_node_that_no_cut_helps_stays_whole():
    x = clouds(400, 400, 0.0)  # unrelated rows: at 0.5 everything is within reach of everything
    tree = mt.grow(x, x, 400, 400, 8, mt.reach_of(0.5), 16, 0)
    assert tree["cut"] == [] and tree["whole"] == [0]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "item bigint, unit array<double>, norm double")


def test_rounds_with_salted_groups_and_samples_lose_nothing(spark, monkeypatch):
    """Several rounds, small samples, several groups a cell, one hot cluster of near copies."""
    monkeypatch.setattr(mt, "SAMPLE_ROWS", 128)
    monkeypatch.setattr(mt, "GROUP_ROWS", 50)
    monkeypatch.setattr(mt, "NODES", 15)
    monkeypatch.setattr(dd, "CELL_ROWS", 40)
    x = np.concatenate([clouds(400, 25, 0.1), clouds(200, 1, 0.01, seed=9)])
    left, right = frame(spark, x), frame(spark, x)
    got = {(r["a"], r["b"]) for r in dd.scored_pairs(left, right, 8, 0.98, True, False).collect()}
    i, j = np.nonzero(np.triu(best(x, x) >= 0.98, 1))
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) >= 200 * 199 // 2


def test_two_tables_of_text_ids_and_an_empty_one(spark):
    x, y = clouds(60, 10, 0.02), clouds(40, 10, 0.02)
    name = lambda d, p: d.selectExpr(f"concat('{p}', item) AS item", "unit", "norm")
    a, b = name(frame(spark, x), "a"), name(frame(spark, y), "b")
    got = {(r["a"], r["b"]) for r in dd.scored_pairs(a, b, 8, 0.99, False, False).collect()}
    i, j = np.nonzero(best(x, y) >= 0.99)
    assert got == {(f"a{p}", f"b{q}") for p, q in zip(i.tolist(), j.tolist())}
    assert dd.scored_pairs(a, b.where("false"), 8, 0.99, False, False).count() == 0


def test_comparisons_grow_below_the_square(spark, monkeypatch):
    """Four times the rows in clusters of the same size: far fewer than 16 times the comparisons."""
    monkeypatch.setattr(mt, "SAMPLE_ROWS", 1024)

    def work(n):
        d = frame(spark, clouds(n, n // 10, 0.05))
        s = mt.cell_sizes(*mt.metric_cells(d, d, 8, 0.9995, 64))
        return s.selectExpr("sum(nh * ng) AS w").first()["w"]

    small, large = work(1000), work(4000)
    assert large < 8 * small and large < 4000 * 4000 / 8


@pytest.fixture(scope="module")
def near_copies(spark):
    """One hot cluster of 300 near copies, a few copies of one row, rows of 60 centres that partly repeat turned."""
    x = np.concatenate([clouds(300, 1, 0.005, seed=2), clouds(60, 60, 0.0, seed=3)]) * 40
    rows = [(i, v.tolist(), ["train", "valid", "test"][i % 3], i % 4) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[310][1], "test", i % 2) for i in range(30)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, role string, label int")


def test_a_cluster_of_near_copies_emits_no_more_edges_than_rows(spark, near_copies, monkeypatch):
    monkeypatch.setattr(dd, "CELL_ROWS", 500)
    relation = dd.strict_items(near_copies.select("id", "v"), 8)
    edges = dd._unlisted(relation, relation["items"], dd.Forest, "a bigint, b bigint").count()
    listed = dd.strict_pairs(near_copies.select("id", "v"), 8)
    pairs = listed["pairs"].where("a <> b").select("a", "b")
    comp = dd.connected_components(pairs).agg({"node": "count"}).first()[0], dd.connected_components(pairs).select("component").distinct().count()
    assert pairs.count() >= 300 * 299 // 2 and edges == comp[0] - comp[1] < 361
    pool = near_copies.where("role <> 'test'").select("id")
    get = lambda r: {x["id"]: x["component"] for x in dd.duplicate_components(r, pool).collect()}
    assert get(relation) == get(listed)


def test_counted_audit_equals_listed_audit(spark, near_copies, monkeypatch):
    monkeypatch.setattr(dd, "CELL_ROWS", 100)
    v = near_copies.select("id", "v")
    claimed = near_copies.where("id % 7 <> 0")
    get = lambda r: sorted(map(tuple, dd.leakage_audit(r, claimed).collect()))
    counted = get(dd.strict_items(v, 8))
    assert counted == get(dd.strict_pairs(v, 8)) and len(counted) == 6
