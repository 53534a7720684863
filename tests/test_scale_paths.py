"""The paths that only large inputs take, forced on small ones and compared with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import vectors as ve
from assay.operators import dedup as dd, features as fe, heads, manifests as ma, metric_tree as mt, resample as rs, selection as se, splits as sp, tests_paired as tp


def brute_pairs(rows, t, orders):
    out = {}
    unit = {}
    for i, v in rows:
        x = np.asarray(v) - np.mean(v)
        unit[i] = x / np.linalg.norm(x)
    for i, _ in rows:
        for j, _ in rows:
            if i < j:
                s = max(float(unit[i] @ unit[j][o]) for o in orders)
                if s >= t - 1e-12:
                    out[(i, j)] = s
    return out


def clustered(n=120, seed=0):
    rng = np.random.default_rng(seed)
    orders = ve.scan_orders(8)
    base = rng.normal(size=(6, 64))
    rows = []
    for i in range(n):
        b = base[i % 6]
        noise = rng.choice([0.0, 0.01, 0.1, 1.0])
        rows.append((i, [float(x) for x in (b + noise * rng.normal(size=64))[orders[rng.integers(8)]]]))
    return rows


@pytest.mark.parametrize("t,block", [(0.98, 4096), (0.98, 7), (0.9995, 5), (0.9, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, t, block):
    monkeypatch.setattr(dd, "CELL_ROWS", block)
    rows = clustered()
    v = spark.createDataFrame(rows, "id bigint, v array<double>")
    out = dd.near_duplicate_pairs(v, 8, t)
    item = {r["id"]: r["item"] for r in out["members"].collect()}
    got = {(r["a"], r["b"]): r["pairs"] for r in out["pairs"].collect()}
    expect = {}
    for (i, j) in brute_pairs(rows, t, ve.scan_orders(8)):
        a, b = sorted((item[i], item[j]))
        expect[(a, b)] = expect.get((a, b), 0) + 1
    assert got == expect


def test_third_of_rows_are_one_picture(spark):
    rows = clustered(60)
    rows += [(1000 + i, rows[0][1]) for i in range(400)]
    v = spark.createDataFrame(rows, "id bigint, v array<double>")
    out = dd.near_duplicate_pairs(v, 8, 0.9999)
    assert out["items"].count() <= 60
    hot = out["pairs"].where("a = b").agg(F.max("pairs")).first()[0]
    assert hot >= 401 * 400 // 2


def test_constant_vectors_pair_with_nothing(spark):
    v = spark.createDataFrame([(i, [1.5] * 64) for i in range(5)], "id bigint, v array<double>")
    assert dd.near_duplicate_pairs(v, 8, 0.9)["pairs"].count() == 0


def test_ordered_grids_never_exceed_distance():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 64))
    x -= x.mean(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.05 * rng.normal(size=x.shape)
    for o in ve.scan_orders(8):
        f, g = mt.ordered(x[:, o], 8), mt.ordered(y, 8)
        assert np.allclose(f, mt.ordered(x, 8))
        assert (np.linalg.norm(f - g, axis=1) <= np.linalg.norm(x - y, axis=1) + 1e-9).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    d = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in dd.connected_components(d).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
    assert len(got) == 501


def group_table(spark, n, strata=1):
    return spark.createDataFrame([(i % strata, f"g{i}", [1.0, float(i)]) for i in range(n)], "stratum int, grp string, v array<double>")


@pytest.mark.parametrize("block", [50_000, 40])
def test_bootstrap_draws_the_right_number_from_any_block(spark, monkeypatch, block):
    monkeypatch.setattr(rs, "BLOCK_GROUPS", block)
    n = 300
    r = [x["v"] for x in rs.cluster_replicates(group_table(spark, n, 2), 400, 7, chunk=100).collect()]
    assert len(r) == 400 and all(v[0] == n for v in r)
    sums = np.array([v[1] for v in r])
    values = [np.arange(s, n, 2) for s in (0, 1)]
    mean, var = sum(v.sum() for v in values), sum(len(v) * v.var() for v in values)
    assert abs(sums.mean() - mean) < 5 * np.sqrt(var / 400)
    assert 0.75 < sums.var() / var < 1.33


def test_block_draws_add_up():
    sizes = [10, 20, 30, 5]
    reps = np.arange(50)
    total = sum(rs.block_draws(1, 0, sizes, b, reps) for b in range(4))
    assert (total == 65).all()


def test_identical_methods_have_no_difference(spark):
    rows = [(1 + i % 5, m, f"f{y}{i}{s}", f"id{y}{i}", y, (y + (i % 3 == 0)) % 2) for m in ("a", "b") for y in (0, 1) for i in range(12) for s in range(2)]
    p = spark.createDataFrame(rows, "fold int, method string, path string, patient_id string, y_true int, y_pred int")
    d = rs.paired_difference_ci(p, "a", "b", 2, 200, pools=("majority_vote",)).collect()
    assert all(r["difference"] == r["ci95_low"] == r["ci95_high"] == 0 for r in d)
    from assay.operators.joins import paired_vs_baselines
    t = rs.paired_sign_flip_test(paired_vs_baselines(p, "a"), ["b"], 200).first()
    assert t["delta_accuracy"] == 0 and t["p_raw"] == 1.0 and t["n_groups"] == 24


@pytest.mark.parametrize("block", [4096, 9])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(heads, "KNN_BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 6))
    x[:60] = x[0] + 0.01 * rng.normal(size=(60, 6))
    rows = [(f"t{i:03d}", i % 3, [float(a) for a in v]) for i, v in enumerate(x)]
    q = [(f"q{i:03d}", 0, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(40, 6)))] + [("q900", 0, rows[3][2])]
    schema = "path string, y int, features array<double>"
    got = {}
    for r in heads.nearest_neighbours(spark.createDataFrame(rows, schema), spark.createDataFrame(q, schema), 4).collect():
        got.setdefault(r["path"], {})[r["rank"]] = r["neighbour"]
    for name, _, v in q:
        d = sorted((round(float(((np.asarray(v) - np.asarray(t)) ** 2).sum()), 9), p) for p, _, t in rows)
        assert [got[name][i + 1] for i in range(4)] == [p for _, p in d[:4]]


def test_bootstrap_draws_do_not_depend_on_the_deal(spark, monkeypatch):
    """Equal bits however replicates and groups are dealt to tasks; several blocks per stratum."""
    monkeypatch.setattr(rs, "BLOCK_GROUPS", 40)
    groups = spark.createDataFrame([(i % 2, f"g{i}", [float(i), 1.0]) for i in range(300)], "stratum int, grp string, v array<double>")
    runs = [{r["rep"]: tuple(r["v"]) for r in rs.cluster_replicates(g, 60, 3, chunk).collect()}
            for g, chunk in ((groups, 250), (groups.repartition(7), 7), (groups.coalesce(1), 1))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 60
    assert all(v[1] == 300 for v in runs[0].values())


def test_mcnemar_of_large_counts(spark):
    from math import comb, erfc, sqrt

    cases = [(4, 11), (78, 184), (480, 1001), (400, 1001), (5, 2000), (900, 2000), (0, 0), (0, 5000), (10 ** 9, 2 * 10 ** 9 + 60_000), (3 * 10 ** 9, 6 * 10 ** 9)]
    d = spark.createDataFrame(cases, "lo long, n long")
    got = {(r.lo, r.n): r.p for r in d.select("lo", "n", tp.binomial_two_sided(d.lo, d.n).alias("p")).collect()}
    for lo, n in cases:
        if n < 10 ** 6:
            want = min(1.0, 2 * sum(comb(n, i) for i in range(lo + 1)) / 2 ** n) if n else 1.0
            assert got[lo, n] == pytest.approx(want, rel=1e-10)
        else:
            assert got[lo, n] == pytest.approx(min(1.0, erfc((n / 2 - lo - 0.5) / sqrt(n / 2))), rel=1e-4)


def test_split_names_beyond_sixteen(spark):
    rows = [(f"p{i}", "a", s, f"g{i}") for i, s in enumerate([f"name{j}" for j in range(40)] + ["train"] * 30 + ["test"] * 5)]
    d = spark.createDataFrame(rows, "path string, label string, split string, grp string")
    out, made = sp.carve_missing_splits(d)
    assert made == ["valid"] and out.where("split = 'test'").count() == 5


def test_exact_counts_that_whole_groups_cannot_give(spark):
    rows = spark.createDataFrame([("a", f"g{i}", 3) for i in range(5)], "label string, grp string, n long")
    want = spark.createDataFrame([("a", 7)], "label string, want long")
    assert sum(r.n for r in sp.exact_count_carve(rows, want).collect()) == 6
    with pytest.raises(ValueError, match="cannot fill"):
        sp.exact_count_carve(rows, want, exact=True)


def test_two_class_thresholds_by_hand(spark):
    rows = [(0, [0.9, 0.1]), (0, [0.6, 0.4]), (1, [0.55, 0.45]), (1, [0.2, 0.8])]
    d = spark.createDataFrame([("m", y, p) for y, p in rows], "m string, y_true int, p array<double>")
    got = {r.cls: r for r in se.tune_thresholds(d, ["m"], 2, "f1_macro", normal_idx=0).collect()}
    assert got[0].threshold == 0.5 and got[1].threshold == pytest.approx(0.425) and got[1].score == 1.0
    got = {r.cls: r for r in se.tune_thresholds(d, ["m"], 2, "bal_acc", normal_idx=1).collect()}
    assert got[1].threshold == 0.5 and got[0].threshold == pytest.approx(0.55 + 0.025)


def test_ranks_of_many_labels(spark):
    d = spark.range(30_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("label"), "id")
    assert ma.label_encode(d).where("y <> id").count() == 0


def test_fresh_groups(spark):
    rows = [(f"p{i}", "ab"[i % 20 // 10], f"g{i // 2}") for i in range(80)]
    m = spark.createDataFrame(rows, "path string, label string, grp string")
    got = sp.fresh_group_split(m, 3).collect()
    role = {}
    for r in got:
        assert role.setdefault(r.grp, r.role) == r.role
    assert len(got) == 80 and {x: list(role.values()).count(x) for x in ("train", "valid", "test")} == {"train": 22, "valid": 8, "test": 10}


def test_single_and_ambiguous_tables(spark):
    d = spark.createDataFrame([("b", "valid", "a", 5, 1.0), ("b", "train", "a", 5, 1.0), ("c", "valid", "a", 5, 1.0)],
                              "backbone string, role string, variant string, rows long, mean_row_norm double")
    got = {(r.backbone, r.role): r.setting for r in fe.view_setting_classifier(d, {("b", "valid"): "view mean"}).collect()}
    assert got == {("b", "valid"): "view mean", ("b", "train"): "plain", ("c", "valid"): "undetermined"}
    three = spark.createDataFrame([("b", "valid", v, 5, n) for v, n in (("a", 1.0), ("b", 0.9), ("c", 0.8))], d.schema)
    with pytest.raises(Exception, match="more than two tables"):
        fe.view_setting_classifier(three).collect()
    assert {r.setting for r in fe.view_setting_classifier(three, strict=False).collect()} == {"undetermined"}
