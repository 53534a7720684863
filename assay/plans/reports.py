"""End-to-end reports composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.functions import posterior as po
from assay.operators import audits, joins, metrics as me


def cv_summary(preds: DataFrame, k: int, reference: str = "proposed", check: bool = True) -> dict[str, DataFrame]:
    """Fold outputs -> validation and alignment -> fold metrics and the summary table."""
    if check:
        audits.require_clean(audits.validate_predictions(preds))
        off = joins.align_methods(preds, reference).where("missing + extra + different > 0").limit(1).count()
        if off:
            raise ValueError("methods do not hold the same cases")
    return {"folds": me.fold_metrics(preds, k), "summary": me.fold_mean_sd(preds, k)}


def evaluate_report(preds: DataFrame, thresholds: list[float], k: int, normal_idx: int | None) -> DataFrame:
    """Thresholded and argmax metrics on rows and on pooled groups, long over (rule, level)."""
    def rules(d: DataFrame, level: str) -> DataFrame:
        each = F.array(
            F.struct(F.lit("argmax").alias("rule"), po.argmax_lowest(F.col("p"), k).alias("y_pred")),
            F.struct(F.lit("threshold").alias("rule"), po.threshold_rule(F.col("p"), thresholds, k, normal_idx).alias("y_pred")))
        return d.select("method", F.lit(level).alias("level"), "y_true", F.explode(each).alias("r")).select(
            "method", "level", "y_true", "r.*")

    truth = me.group_majority_label(preds, "patient_id", "y_true")
    pooled = me.mean_posterior_pool(preds, ["method", "patient_id"], k).select("method", "patient_id", "p").join(truth, "patient_id")
    keys = ["method", "rule", "level"]
    cm = me.confusion_counts(rules(preds, "slice").unionByName(rules(pooled, "group")), keys)
    return me.metrics_from_confusion(cm, keys, k)


def held_out_report(preds: DataFrame, thresholds: list[float], k: int, normal_idx: int | None, temperature: float = 1.0,
                selected: str = "threshold", n_rep: int = 2000, seed: int = 42) -> dict[str, DataFrame]:
    """The full report on held-out posteriors (method, path, patient_id, y_true, p), one table per part.

    - rules: every decision rule on rows and on pooled groups, with macro scores, presence misses, type errors, expected
      risk and the accuracy gained over the plain argmax; ``selected`` marks the rule chosen on validation.
    - calibration: calibration error of the posteriors as given and after the temperature.
    - intervals: accuracy under resampling of groups, for the rows under the selected rule, and for the pooled groups under
      the better of the selected rule and the argmax (the argmax where both are level).
    - row_intervals: accuracy and balanced accuracy under resampling of rows, and how many times wider the grouped interval is
      (null where either has no width).

    A group's truth is its majority label. No input rows: all tables are empty.
    """
    from assay.operators import resample as rs, selection
    from assay.session import write_and_read

    p = F.col("p")
    rule = selection.rule_columns(p, po.temperature_apply(p, temperature, k), thresholds, k, normal_idx)
    # an interval is of the selected rule or of the argmax
    right = [(rule[r] == F.col("y_true")).cast("int") if r in rule else F.lit(0) for r in ("argmax", selected)]
    # rows meet once by group and label: what is summed here is all that the groups' figures need
    sums = [x for i, v in enumerate(po.slots(p, k)) for x in (F.sum(v).alias(f"s{i}"), F.count(v).alias(f"m{i}"))]
    groups = write_and_read(preds.groupBy("method", "patient_id", "y_true").agg(
        F.count(F.lit(1)).alias("n"), F.sum(right[0]).alias("plain_ok"), F.sum(right[1]).alias("selected_ok"), *sums), "report-groups")
    truth = me.group_majority_label(groups, "patient_id", "y_true", "n")
    means = [F.when(F.sum(f"m{i}") > 0, F.sum(f"s{i}") / F.sum(f"m{i}")) for i in range(k)]
    pooled = groups.groupBy("method", "patient_id").agg(F.array(*means).alias("p")).join(truth, "patient_id")
    pooled = write_and_read(pooled.select("method", "patient_id", "y_true", "p", F.lit(1).cast("long").alias("n"),
                                          right[0].cast("long").alias("plain_ok"), right[1].cast("long").alias("selected_ok")), "report-pooled")
    # equal posteriors are decided once
    cases = selection.distinct_posteriors(preds, ["method", "y_true"]).select("method", F.lit("slice").alias("level"), "y_true", "p", "n").unionByName(
        pooled.select("method", F.lit("group").alias("level"), "y_true", "p", "n"))
    decided = selection.decision_rules(cases, thresholds, k, normal_idx, temperature, ("level", "y_true", "n"))
    keys = ["method", "level", "rule"]
    cm = write_and_read(decided.groupBy(*keys, "y_true", F.col("decision").alias("y_pred")).agg(F.sum("n").alias("n")), "report-counts")
    codes = preds.sparkSession.range(k).select(F.col("id").cast("int").alias("y_true"))
    risk = me.expected_risk(cm, keys, selection.cost_table(codes, normal_idx))
    rules = me.metrics_full_report(cm, keys, k).join(risk, keys).join(me.miss_kinds(cm, keys, normal_idx), keys)
    plain = rules.where("rule = 'argmax'").select("method", "level", F.col("accuracy").alias("_plain"))
    rules = write_and_read(rules.join(plain, ["method", "level"]).withColumn("accuracy_gain", F.col("accuracy") - F.col("_plain"))
                           .withColumn("selected", F.col("rule") == selected).drop("_plain"), "report-rules")

    raw = me.ece(preds, ["method"], k).withColumnRenamed("ece", "ece_raw")
    warm = preds.select("method", "y_true", po.temperature_apply(F.col("p"), temperature, k).alias("p"))
    calibration = raw.join(me.ece(warm, ["method"], k).withColumnRenamed("ece", "ece_cal"), "method")

    gained = (F.col("level") == "group") & (F.col("accuracy_gain") <= 0)
    used = rules.where("selected").select("method", "level", F.when(gained, "argmax").otherwise(F.lit(selected)).alias("rule"))
    of_rule = rules.select(*keys, "accuracy").join(used, keys)
    names = sorted(r["method"] for r in used.select("method").distinct().collect())  # the methods under report

    def span(counts: DataFrame, level: str) -> DataFrame:
        mine = counts.join(F.broadcast(used.where(F.col("level") == level)), "method")  # one row a method
        ok = F.when(F.col("rule") == selected, F.col("selected_ok")).otherwise(F.col("plain_ok")).alias("ok")
        return rs.cluster_bootstrap_hits(rs.summed_hits(mine.select("method", "patient_id", ok, "n"), names), names, n_rep, seed).withColumn("level", F.lit(level))

    spans = [span(groups, "slice"), span(pooled, "group")] if names else []
    each = spans[0].unionByName(spans[1]) if names else preds.sparkSession.createDataFrame(
        [], "method string, mean double, lo double, hi double, n_units bigint, level string")
    intervals = of_rule.join(each, ["method", "level"])

    rows_cm = cm.where((F.col("level") == "slice") & (F.col("rule") == selected))
    iid = rs.iid_bootstrap(rows_cm, ["method"], k, n_rep, seed)
    ratio = rs.ci_width_ratio(each.where("level = 'slice'"), iid, "method")
    return {"rules": rules, "calibration": calibration, "intervals": intervals, "row_intervals": iid.join(ratio, "method", "left")}


def oof_analysis(preds: DataFrame, a: str, b: str, k: int, n_rep: int = 2000, seed: int = 42) -> dict[str, DataFrame]:
    """The post-hoc report on out-of-fold predictions: intervals, paired differences, exact
    tests, group decisions, fold metrics and their mean and SD."""
    from assay.operators import resample as rs, tests_paired as tp

    audits.require_clean(audits.validate_predictions(preds))
    methods = sorted(r["method"] for r in preds.select("method").distinct().collect())
    if not {a, b} <= set(methods):
        raise ValueError(f"comparison methods absent: {methods}")
    pools = ("majority_vote",)
    if "p" in preds.columns:
        audits.require_clean(audits.validate_posteriors(preds, k))
        pools = ("majority_vote", "mean_probability")
    truth = preds.groupBy("patient_id").agg(F.first("y_true").alias("y_true"), F.first("fold").alias("fold"))
    decisions = me.majority_vote(preds).withColumn("pooling", F.lit("majority_vote"))
    if len(pools) > 1:
        mean = me.mean_posterior_pool(preds, ["method", "patient_id"], k).drop("p").withColumn("pooling", F.lit("mean_probability"))
        decisions = decisions.unionByName(mean)
    # one bootstrap for both tables
    point, reps = rs.bootstrap_tables(preds, methods, k, n_rep, seed, pools)
    keys = ["method", "unit", "metric"]
    est = rs.long_metrics(point, ["method", "unit"]).withColumnRenamed("value", "estimate")
    ci = rs.percentile_ci(rs.long_metrics(reps, ["method", "unit"]), keys)
    obs = rs.long_metrics(rs._difference(point, a, b, []), ["unit"]).withColumnRenamed("value", "difference")
    dci = rs.percentile_ci(rs.long_metrics(rs._difference(reps, a, b, ["rep"]), ["unit"]), ["unit", "metric"])
    return {
        "metric_intervals": est.join(ci, keys),
        "paired_differences": obs.join(dci, ["unit", "metric"]),
        "mcnemar": tp.mcnemar_by_unit(preds, a, b, k),
        "group_decisions": decisions.join(truth, "patient_id"),
        "fold_metrics": me.fold_metrics(preds, k),
        "fold_mean_sd": me.fold_mean_sd(preds, k),
    }


def paired_comparison_report(preds: DataFrame, proposed: str, baselines: list[str], k: int, n_rep: int = 2000,
                             seed: int = 42) -> dict[str, DataFrame]:
    """Results of all methods and the paired comparisons in declared order; no ranking by score."""
    from assay.operators import resample as rs

    cm = me.confusion_counts(preds, ["method"])
    pairs = joins.paired_vs_baselines(preds.where(F.col("method").isin(proposed, *baselines)), proposed)
    comps = rs.comparison_family(pairs, baselines, n_rep, seed)
    return {"results": me.metrics_full_report(cm, ["method"], k), "confusion": cm,
            "comparisons": comps.withColumn("comparison", F.concat(F.lit(f"{proposed} minus "), "baseline"))}


def readiness_report(features: DataFrame, baselines: list, binds: DataFrame | None = None) -> DataFrame:
    """(part, key, n): role overlap, feature rows per block and role, runnable baselines (1 or 0), and, of the bind log
    ``binds`` (role, backbone, requested, effective, note), the binds served at another setting than the requested one.

    A substitution's key is role|backbone|requested|effective|note. A bind whose effective setting is unknown is none.
    """
    from assay.operators.manifests import role_crossing_groups
    from assay.plans.modelling import available

    overlap = role_crossing_groups(features.select(F.col("path").alias("grp"), F.col("role").alias("split"))).select(
        F.lit("overlap").alias("part"), F.concat_ws("|", "role_a", "role_b").alias("key"), F.col("shared").alias("n"))
    rows = features.groupBy("backbone", "role").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rows").alias("part"), F.concat_ws("|", "backbone", "role").alias("key"), "n")
    ok, missing = available(features, baselines)
    run = features.sparkSession.createDataFrame([(b.key, 1) for b in ok] + [(key, 0) for key, _ in missing], "key string, n bigint")
    out = overlap.unionByName(rows).unionByName(run.select(F.lit("baseline").alias("part"), "key", "n"))
    if binds is None:
        return out
    return out.unionByName(audits.substitutions(binds).select(
        F.lit("substitution").alias("part"),
        F.concat_ws("|", "role", "backbone", "requested", "effective", F.coalesce("note", F.lit(""))).alias("key"), F.col("binds").alias("n")))
