"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from assay.functions import posterior as po, text as tx
from assay.operators import audits, manifests as ma, metrics as me, selection, tests_paired as tp


def confusion(spark, rows):
    return spark.createDataFrame([("m", y, p, n) for y, p, n in rows], "method string, y_true int, y_pred int, n bigint")


def test_perfect_confusion(spark):
    r = me.metrics_from_confusion(confusion(spark, [(0, 0, 4), (1, 1, 7), (2, 2, 3)]), ["method"], 3).first()
    assert (r["accuracy"], r["balanced_accuracy"], r["macro_f1"]) == (1.0, 1.0, 1.0)


def test_two_by_two_confusion(spark):
    r = me.metrics_from_confusion(confusion(spark, [(0, 0, 3), (0, 1, 1), (1, 0, 2), (1, 1, 4)]), ["method"], 2).first()
    assert r["accuracy"] == pytest.approx(0.7)
    assert r["balanced_accuracy"] == pytest.approx((0.75 + 4 / 6) / 2)
    assert r["macro_f1"] == pytest.approx((6 / 9 + 8 / 11) / 2)


def test_absent_class_conventions(spark):
    cm = confusion(spark, [(0, 0, 3), (1, 0, 1), (1, 1, 3)])
    assert me.metrics_from_confusion(cm, ["method"], 3).first()["balanced_accuracy"] == pytest.approx((1 + 0.75) / 3)
    assert me.metrics_full_report(cm, ["method"], 3).first()["balanced_accuracy"] == pytest.approx((1 + 0.75) / 2)
    with pytest.raises(Exception, match="absent"):
        me.metrics_strict(cm, ["method"], 3).collect()


@pytest.mark.parametrize("ab,ba,p", [(4, 7, 0.548828125), (78, 106, 0.04624472804214582), (0, 0, 1.0), (5, 5, 1.0), (0, 6, 0.03125)])
def test_exact_mcnemar(spark, ab, ba, p):
    rows = [(1, 1, 0)] * ab + [(1, 0, 1)] * ba + [(1, 1, 1)] * 3
    d = spark.createDataFrame(rows, "y_true int, pred_a int, pred_b int").withColumn("k", F.lit(1))
    r = tp.exact_mcnemar(d, ["k"]).first()
    assert (r["a_correct_b_wrong"], r["a_wrong_b_correct"]) == (ab, ba)
    assert r["p_exact_two_sided"] == pytest.approx(p, rel=1e-12)


def test_exact_mcnemar_large(spark):
    d = spark.createDataFrame([(900, 2000)], "lo bigint, n bigint")
    got = d.select(tp.binomial_two_sided(F.col("lo"), F.col("n")).alias("p")).first()["p"]
    logs = [math.lgamma(2001) - math.lgamma(i + 1) - math.lgamma(2001 - i) - 2000 * math.log(2) for i in range(901)]
    assert got == pytest.approx(2 * sum(math.exp(x) for x in logs), rel=1e-9)


def holm(spark, ps):
    d = spark.createDataFrame([(0, i, p) for i, p in enumerate(ps)], "f int, i int, p double")
    return [r["p_holm"] for r in tp.holm_adjust(d, ["f"], "p", "i").orderBy("i").collect()]


def test_holm(spark):
    assert holm(spark, [0.001, 0.04]) == pytest.approx([0.002, 0.04])
    assert holm(spark, [0.04, 0.01, 0.03]) == pytest.approx([0.06, 0.03, 0.06])


def predictions(spark, edit=None):
    rows = []
    for m in ("a", "b"):
        for y in (0, 1):
            for i in range(3):
                for s in range(2):
                    rows.append([1 + i % 3, m, f"f{y}{i}{s}", f"id{y}{i}", y, y])
    if edit:
        edit(rows)
    return spark.createDataFrame(rows, "fold int, method string, path string, patient_id string, y_true int, y_pred int")


def broken(spark, edit):
    return {r["rule"] for r in audits.validate_predictions(predictions(spark, edit)).where("violations > 0").collect()}


def test_prediction_rules(spark):
    assert broken(spark, None) == set()
    assert broken(spark, lambda r: r.append(list(r[0]))) == {"repeated_method_path"}
    assert broken(spark, lambda r: r[0].__setitem__(3, " ")) >= {"blank_identifier", "path_in_two_groups"}
    assert broken(spark, lambda r: r[0].__setitem__(0, 5)) == {"group_crosses_folds"}
    assert broken(spark, lambda r: r[0].__setitem__(5, 9)) == {"unknown_predicted_label"}
    with pytest.raises(ValueError, match="group_crosses_folds"):
        audits.require_clean(audits.validate_predictions(predictions(spark, lambda r: r[0].__setitem__(0, 5))))
    with pytest.raises(ValueError, match="missing prediction columns"):
        audits.validate_predictions(predictions(spark).drop("fold"))


def test_rules_on_posteriors(spark):
    d = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "p array<double>")
    p = F.col("p")
    assert [r[0] for r in d.select(po.argmax_lowest(p, 3)).collect()] == [1, 0, 2]
    assert [r[0] for r in d.select(po.has_tie(p, 3)).collect()] == [False, True, False]
    assert [r[0] for r in d.select(po.threshold_rule(p, [0.1, 0.6, 0.9], 3)).collect()] == [0, 0, 0]
    assert [r[0] for r in d.select(po.threshold_rule(p, [0.9, 0.9, 0.9], 3)).collect()] == [1, 0, 2]
    cost = po.cost_matrix(3, 0)
    want = [min(range(3), key=lambda j: sum(q[i] * cost[i][j] for i in range(3))) for q in ([0.2, 0.5, 0.3], [0.4, 0.4, 0.2], [0.1, 0.2, 0.7])]
    assert [r[0] for r in d.select(po.bayes_rule(p, cost)).collect()] == want
    t = d.select(po.temperature_apply(p, 2.0, 3).alias("q")).first()["q"]
    raw = [math.sqrt(x) for x in (0.2, 0.5, 0.3)]
    assert t == pytest.approx([x / sum(raw) for x in raw])


def test_many_classes_argmax(spark):
    d = spark.createDataFrame([([0.05] * 9 + [0.55],), ([0.1] * 10,)], "p array<double>")
    assert [r[0] for r in d.select(po.argmax_lowest(F.col("p"), 10)).collect()] == [9, 0]


def test_names(spark):
    d = spark.createDataFrame([("a\\b\\MR024780B__17.png",), ("x/100820__209.png",), ("plain.tar.gz",)], "p string")
    gid = tx.group_id_from_path(F.col("p"))
    assert [r[0] for r in d.select(gid).collect()] == ["MR024780B", "100820", "plain.tar"]
    assert [r[0] for r in d.select(tx.group_family(gid)).collect()] == ["MR024780", "100820", "plain.tar"]
    with pytest.raises(Exception, match="unknown split"):
        spark.createDataFrame([("holdout",)], "s string").select(tx.normalize_split(F.col("s"))).collect()


def test_digest_depends_on_order_and_content(spark):
    def digest(rows):
        return ma.manifest_digest(spark.createDataFrame(rows, "k int, pos bigint, path string, label string"), ["k"]).first()["digest"]
    base = [(1, i, f"f{i}", "x") for i in range(9000)]
    assert digest(base) == digest(list(reversed(base)))
    swapped = [(1, i if i > 1 else 1 - i, p, lab) for _, i, p, lab in base]
    assert digest(base) != digest(swapped)
    assert digest(base) != digest(base[:-1])


def test_early_stop(spark):
    scores = [0.5, 0.6, 0.6, 0.55, 0.7, 0.1, 0.2, 0.3, 0.9]
    log = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], "run string, epoch bigint, score double")
    for width in (2, 1000):
        r = selection.early_stop(log, ["run"], "epoch", "score", 3, width).first()
        assert (r["chosen_epoch"], r["best_score"], r["stop_epoch"]) == (5, 0.7, 8)


def test_temperature_of_calibrated_posteriors(spark):
    rows = [([0.8, 0.2], 0)] * 80 + [([0.8, 0.2], 1)] * 20
    d = spark.createDataFrame(rows, "p array<double>, y_true int").withColumn("k", F.lit("x"))
    assert selection.temperature_fit(d, ["k"]).first()["temperature"] == pytest.approx(1.0, abs=1e-2)


def test_weight_grid():
    assert len(selection.weight_grid(4)) == 286
    assert selection.weight_grid(2, 0.5) == [[0.0, 1.0], [0.5, 0.5], [1.0, 0.0]]
    assert po.default_weights(["svm", "xgboost"]) == pytest.approx([3 / 7, 4 / 7])


def test_held_out_report(spark):
    from assay.plans.reports import held_out_report

    # two groups a class; thresholds move the second row of "n0" to class 1
    rows = [("a", "n0", "n", 0, [0.9, 0.1]), ("a", "n1", "n", 0, [0.6, 0.4]), ("a", "q0", "q", 1, [0.6, 0.4]), ("a", "q1", "q", 1, [0.2, 0.8])]
    d = spark.createDataFrame(rows, "method string, path string, patient_id string, y_true int, p array<double>")
    t = {k: v.collect() for k, v in held_out_report(d, [0.5, 0.4], 2, 0, n_rep=50).items()}
    at = {(r["level"], r["rule"]): r for r in t["rules"]}
    plain, moved = at["slice", "argmax"], at["slice", "threshold"]
    assert (plain["accuracy"], plain["fnr_presence"], plain["n"]) == (0.75, 0.5, 4)
    assert (moved["accuracy"], moved["fnr_presence"], moved["accuracy_gain"]) == (0.75, 0.0, 0.0)
    assert moved["selected"] and not plain["selected"] and plain["expected_risk"] == 2.5 and moved["expected_risk"] == 0.25
    assert at["group", "argmax"]["accuracy"] == at["group", "threshold"]["accuracy"] == 1.0
    spans = {r["level"]: r for r in t["intervals"]}
    assert spans["group"]["rule"] == "argmax" and (spans["group"]["lo"], spans["group"]["hi"], spans["group"]["n_units"]) == (1.0, 1.0, 2)
    assert spans["slice"]["rule"] == "threshold" and 0 <= spans["slice"]["lo"] <= spans["slice"]["hi"] <= 1
    assert len(t["calibration"]) == len(t["row_intervals"]) == 1
    none = held_out_report(d.limit(0), [0.5, 0.4], 2, 0, n_rep=50)
    assert {k: v.count() for k, v in none.items()} == dict.fromkeys(t, 0)
