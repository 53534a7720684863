"""Paired tests on prediction pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.operators import joins, metrics


def _stirling_error(n: Column) -> Column:
    """log n! minus Stirling's formula, for n of 16 and more."""
    n2 = n * n
    return (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - F.lit(1 / 1188) / n2) / n2) / n2) / n2) / n


def _log_half_binomial(x: Column, n: Column) -> Column:
    """log of C(n, x) / 2^n for large n; differences of logs are taken of ratios near one, so that
    no digits are lost when n is in the billions."""
    y = n - x
    away = (y - x) / n  # x = n (1 - away) / 2
    deviance = x * F.log1p(-away) + y * F.log1p(away)
    return (F.log(n / (2 * math.pi * x * y)) / 2 + _stirling_error(n) - _stirling_error(x) - _stirling_error(y) - deviance)


#: above this many discordant rows, and 16 on either side, the closed form is used
CLOSED_FORM = 1000


def binomial_two_sided(lo: Column, n: Column) -> Column:
    """min(1, 2 * sum_{i<=lo} C(n, i) / 2^n), by the ratio of neighbouring terms in logs.

    The terms are added from the largest one (i = lo) down, so nothing underflows. They shrink at
    least as fast as a normal tail, so 10 sqrt(n) + 50 of them hold all digits of the sum.
    """
    lo, n = lo.cast("bigint"), n.cast("bigint")
    # log C(n, lo) = sum of log((n - j + 1) / j)
    steps = lambda upto: F.when(upto > 0, F.sequence(F.lit(1).cast("bigint"), upto)).otherwise(F.array().cast("array<bigint>"))
    x, m = lo.cast("double"), n.cast("double")
    far = (n > CLOSED_FORM) & (lo >= 16)
    log_top = F.when(far, _log_half_binomial(x, m)).otherwise(F.aggregate(
        steps(F.when(far, F.lit(0).cast("bigint")).otherwise(lo)), F.lit(0.0), lambda s, j: s + F.log((n - j + 1) / j)) - n * F.log(F.lit(2.0)))
    # going down from i = lo: term(i-1) = term(i) * i / (n - i + 1)
    terms = F.least(lo, (F.lit(10.0) * F.sqrt(m) + 50).cast("bigint"))
    down = F.aggregate(
        steps(terms), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, j: F.struct((s["term"] * (lo - j + 1) / (n - lo + j)).alias("term"),
                              (s["total"] + s["term"] * (lo - j + 1) / (n - lo + j)).alias("total")),
        lambda s: s["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * F.exp(log_top) * down))


def exact_mcnemar(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Discordant counts and the exact two-sided p per key."""
    a, b = F.col("pred_a") == F.col("y_true"), F.col("pred_b") == F.col("y_true")
    d = pairs.groupBy(*keys).agg(
        F.sum((a & ~b).cast("int")).cast("bigint").alias("a_correct_b_wrong"),
        F.sum((~a & b).cast("int")).cast("bigint").alias("a_wrong_b_correct"))
    n = F.col("a_correct_b_wrong") + F.col("a_wrong_b_correct")
    lo = F.least("a_correct_b_wrong", "a_wrong_b_correct")
    return d.withColumn("discordant", n).withColumn("p_exact_two_sided", binomial_two_sided(lo, F.col("discordant")))


def mcnemar_by_unit(preds: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """The test on rows (diagnostic only) and on each pooled group decision."""
    two = preds.where(F.col("method").isin(a, b))
    truth = two.where(F.col("method") == a).groupBy("patient_id").agg(F.first("y_true").alias("y_true"))
    slices = joins.paired_predictions(two, a, b).select(
        F.lit("slice_IID_DIAGNOSTIC_ONLY").alias("unit"), "y_true", "pred_a", "pred_b")
    parts = slices
    pools = {
        "identifier_majority_vote": metrics.majority_vote(two),
        "identifier_mean_probability": metrics.mean_posterior_pool(two, ["method", "patient_id"], k),
    }
    for unit, d in pools.items():
        wide = d.groupBy("patient_id").agg(
            F.max(F.when(F.col("method") == a, F.col("y_pred"))).alias("pred_a"),
            F.max(F.when(F.col("method") == b, F.col("y_pred"))).alias("pred_b"))
        parts = parts.unionByName(wide.join(truth, "patient_id").select(
            F.lit(unit).alias("unit"), "y_true", "pred_a", "pred_b"))
    return exact_mcnemar(parts, ["unit"])


def holm_adjust(tests: DataFrame, family: list[str], p: str, order: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p: running maximum of min(1, (m - rank) p) in ascending p.

    A family is a short list of declared comparisons, one row each.
    """
    w = Window.partitionBy(*family)
    ranked = tests.withColumn("_r", F.row_number().over(w.orderBy(p, order))).withColumn("_m", F.count(F.lit(1)).over(w))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    run = w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_s", step).withColumn(out, F.max("_s").over(run)).drop("_r", "_m", "_s")
