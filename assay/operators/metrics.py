"""Confusion-matrix metrics. The confusion counts are the only pass over the predictions;
everything after them works on tables of (keys x classes squared) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions.posterior import argmax_lowest, has_tie

METRICS = ("accuracy", "balanced_accuracy", "macro_f1")


def confusion_counts(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per (keys, y_true, y_pred)."""
    return preds.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def per_class_counts(cm: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, cls, tp, actual, predicted) from confusion counts; works for weighted counts too."""
    c = F.col(n)
    zero = c * 0
    hit = F.when(F.col("y_true") == F.col("y_pred"), c).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("cls"), hit.alias("tp"), c.alias("actual"), zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("cls"), zero.alias("tp"), zero.alias("actual"), c.alias("predicted")),
    )
    return (
        cm.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
        .groupBy(*keys, "cls")
        .agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics_from_confusion(cm: DataFrame, keys: list[str], k: int, n: str = "n") -> DataFrame:
    """Accuracy, balanced accuracy and macro F1; a class that never occurs counts as 0."""
    c = per_class_counts(cm, keys, n)
    return c.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        (F.sum(ratio(F.col("tp"), F.col("actual"))) / k).alias("balanced_accuracy"),
        (F.sum(ratio(2 * F.col("tp"), F.col("actual") + F.col("predicted"))) / k).alias("macro_f1"),
    )


def metrics_strict(cm: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The same three from precision and recall; an absent true class or a code
    outside 0..k-1 is an error."""
    c = per_class_counts(cm, keys)
    prec, rec = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("actual"))
    out = c.groupBy(*keys).agg(
        F.sum(F.when(F.col("actual") > 0, 1).otherwise(0)).alias("_present"),
        F.min("cls").alias("_lo"), F.max("cls").alias("_hi"),
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        (F.sum(rec) / k).alias("balanced_accuracy"),
        (F.sum(ratio(2 * prec * rec, prec + rec)) / k).alias("macro_f1"),
    )
    bad = (F.col("_present") < k) | (F.col("_lo") < 0) | (F.col("_hi") >= k)
    guard = F.when(bad, F.raise_error(F.lit("a class is absent or a class code is invalid")).cast("double"))
    return out.select(*keys, F.coalesce(guard, F.col("accuracy")).alias("accuracy"), "balanced_accuracy", "macro_f1")


def metrics_per_class(cm: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1, miss rate and support per class that occurs."""
    prec, rec = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("actual"))
    return per_class_counts(cm, keys).select(
        *keys, "cls", prec.alias("precision"), rec.alias("recall"),
        ratio(2 * prec * rec, prec + rec).alias("f1"),
        ratio(F.col("actual") - F.col("tp"), F.col("actual")).alias("fnr"),
        F.col("actual").alias("support"),
    )


def metrics_full_report(cm: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Macro scores over the classes that occur, balanced accuracy over the true ones,
    the miss-rate mean over all k, and the four binary cells of class 1 against class 0."""
    c = per_class_counts(cm, keys)
    prec, rec = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("actual"))
    macro = c.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg(F.when(F.col("actual") > 0, rec)).alias("balanced_accuracy"),
        F.avg(ratio(2 * prec * rec, prec + rec)).alias("f1_macro"),
        F.avg(prec).alias("precision_macro"),
        F.avg(rec).alias("recall_macro"),
        (F.sum(ratio(F.col("actual") - F.col("tp"), F.col("actual"))) / k).alias("fnr_macro"),
    )
    if k != 2:
        return macro
    cells = [F.coalesce(F.sum(F.when((F.col("y_true") == a) & (F.col("y_pred") == b), F.col("n"))), F.lit(0)).alias(nm)
             for nm, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    pos = c.where(F.col("cls") == 1).select(
        *keys, ratio(2 * F.col("tp"), F.col("actual") + F.col("predicted")).alias("f1_pos"),
        prec.alias("precision_pos"), rec.alias("recall_pos"))
    return macro.join(cm.groupBy(*keys).agg(*cells), keys).join(pos, keys, "left")


def miss_rate_presence(preds: DataFrame, keys: list[str], normal_idx: int | None) -> DataFrame:
    """Share of the non-normal rows that were called normal; null where there are none."""
    y, p = F.col("y_true"), F.col("y_pred")
    expr = F.lit(None).cast("double") if normal_idx is None else F.avg(
        F.when(y != normal_idx, (p == normal_idx).cast("int")))
    return preds.groupBy(*keys).agg(expr.alias("fnr_presence"))


def type_error_rate(preds: DataFrame, keys: list[str], normal_idx: int | None) -> DataFrame:
    """Among the non-normal rows: wrong class, yet not called normal."""
    y, p = F.col("y_true"), F.col("y_pred")
    wrong = p != y
    if normal_idx is not None:
        expr = F.avg(F.when(y != normal_idx, (wrong & (p != normal_idx)).cast("int")))
    else:
        expr = F.avg(wrong.cast("int"))
    return preds.groupBy(*keys).agg(expr.alias("type_error_rate"))


def miss_kinds(cm: DataFrame, keys: list[str], normal_idx: int | None) -> DataFrame:
    """Rows, presence misses and type errors per key from confusion counts, as ``miss_rate_presence`` and
    ``type_error_rate`` give them from rows."""
    y, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    other = F.lit(True) if normal_idx is None else y != normal_idx
    called = F.lit(False) if normal_idx is None else p == normal_idx
    of_others = lambda cond: F.sum(F.when(other & cond, n).otherwise(0)) / F.sum(F.when(other, n))
    missed = F.lit(None).cast("double") if normal_idx is None else of_others(called)
    return cm.groupBy(*keys).agg(F.sum("n").alias("n"), missed.alias("fnr_presence"), of_others((p != y) & ~called).alias("type_error_rate"))


def expected_risk(cm: DataFrame, keys: list[str], cost: DataFrame) -> DataFrame:
    """Mean cost; ``cost`` is (y_true, y_pred, cost) with k*k rows, hence broadcast."""
    return (
        cm.join(F.broadcast(cost), ["y_true", "y_pred"])
        .groupBy(*keys).agg((F.sum(F.col("n") * F.col("cost")) / F.sum("n")).alias("expected_risk"))
    )


def ece(preds: DataFrame, keys: list[str], k: int, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi] of the largest posterior."""
    conf = F.array_max("p")
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)]
    b = F.lit(0)
    for e in edges:
        b = b + (F.col("conf") > F.lit(e)).cast("int")
    rows = preds.select(*keys, conf.alias("conf"), (argmax_lowest(F.col("p"), k) == F.col("y_true")).cast("int").alias("ok"))
    # a posterior of zero lies in no bin but counts as a row
    b = F.when(F.col("conf") > 0, b).otherwise(F.lit(-1))
    per_bin = rows.withColumn("bin", b).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("m"), F.avg("ok").alias("acc"), F.avg("conf").alias("conf"))
    gap = F.when(F.col("bin") >= 0, F.col("m") * F.abs(F.col("acc") - F.col("conf"))).otherwise(F.lit(0.0))
    return per_bin.groupBy(*keys).agg((F.sum(gap) / F.sum("m")).alias("ece"))


def fold_metrics(preds: DataFrame, k: int) -> DataFrame:
    """Metrics per method and fold with row and group counts."""
    keys = ["method", "fold"]
    m = metrics_from_confusion(confusion_counts(preds, keys), keys, k)
    sizes = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct("patient_id").alias("patients"))
    return m.join(sizes, keys)


def fold_mean_sd(preds: DataFrame, k: int) -> DataFrame:
    """Unweighted mean and sample SD over the folds beside the metric of all rows pooled.

    One pass: the pooled counts are the sum of the fold counts.
    """
    cm = confusion_counts(preds, ["method", "fold"])
    per_fold = metrics_from_confusion(cm, ["method", "fold"], k)
    pooled_cm = cm.groupBy("method", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    pooled = metrics_from_confusion(pooled_cm, ["method"], k)
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    spread = per_fold.groupBy("method").agg(*aggs)
    return spread.join(pooled.select("method", *[F.col(m).alias(f"{m}_pooled_oof") for m in METRICS]), "method")


def group_majority_label(rows: DataFrame, group: str, label: str, n: str | None = None) -> DataFrame:
    """Most frequent label of each group, the lowest on ties; ``n`` says how many rows a row stands for."""
    counts = rows.groupBy(group, label).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"))
    return counts.groupBy(group).agg(
        F.min_by(label, F.struct((-F.col("n")).alias("a"), F.col(label).alias("b"))).alias(label))


def majority_vote(preds: DataFrame) -> DataFrame:
    """One decision per (method, group) from its rows, with the tie flag and row count."""
    counts = preds.groupBy("method", "patient_id", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupBy("method", "patient_id")
        .agg(
            F.max_by("y_pred", F.struct("n", -F.col("y_pred"))).alias("y_pred"),
            F.sum("n").alias("slices"),
            F.collect_list("n").alias("ns"),  # at most one entry per class
        )
        .withColumn("tie", F.size(F.filter("ns", lambda x: x == F.array_max("ns"))) > 1)
        .drop("ns")
    )


def mean_posterior_pool(preds: DataFrame, keys: list[str], k: int, renormalise: bool = False) -> DataFrame:
    """Mean posterior per group, then the lowest argmax and its tie flag."""
    means = preds.groupBy(*keys).agg(
        F.array(*[F.avg(F.get("p", F.lit(i))) for i in range(k)]).alias("p"),
        F.count(F.lit(1)).alias("slices"),
    )
    if renormalise:
        s = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
        means = means.withColumn("p", F.transform("p", lambda x: x / F.greatest(s, F.lit(1e-12))))
    return means.withColumn("y_pred", argmax_lowest(F.col("p"), k)).withColumn("tie", has_tie(F.col("p"), k))


def class_balance_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) per class."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    # one row of totals
    return c.join(F.broadcast(tot)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def confidence_weights(preds: DataFrame, normal_idx: int | None, gamma: float = 2.0,
                       penalty: float = 5.0) -> DataFrame:
    """(1 - p_true)^gamma, times the penalty for non-normal rows, over the mean weight."""
    pt = F.get("p", F.col("y_true"))
    w = F.pow(F.lit(1.0) - pt, F.lit(float(gamma))) if gamma != 0 else F.lit(1.0)
    if normal_idx is not None and penalty != 1.0:
        w = w * F.when(F.col("y_true") != normal_idx, F.lit(float(penalty))).otherwise(F.lit(1.0))
    weighted = preds.withColumn("w", w)
    mean = weighted.agg(F.greatest(F.avg("w"), F.lit(1e-8)).alias("mean_w"))
    return weighted.join(F.broadcast(mean)).withColumn("weight", F.col("w") / F.col("mean_w")).drop("w", "mean_w")
