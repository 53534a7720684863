"""Selection on validation, baseline tables and cross-validation. Loops run over
configurations, never over rows; every step of a configuration is a Spark job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.functions import posterior as po
from assay.operators import boosting, joins, linear, metrics as me, selection
from assay.operators.blocks import to_blocks
from assay.operators.ensemble import weight_search
from assay.operators.features import fit_representation
from assay.operators.heads import fit_head
from assay.session import write_and_read


@dataclass
class Baseline:
    key: str
    spec: str
    head: str
    standardize: str = "per_dim"
    pca: float = 0.0
    kwargs: dict = field(default_factory=dict)


def available(features: DataFrame, baselines: list[Baseline]) -> tuple[list[Baseline], list[tuple[str, str]]]:
    """Baselines whose blocks all exist, and (key, reason) for the others."""
    have = {r["backbone"] for r in features.select("backbone").distinct().collect()}
    ok, missing = [], []
    for b in baselines:
        gone = [x for x in b.spec.split("+") if x not in have]
        if gone:
            missing.append((b.key, "missing blocks: " + ",".join(gone)))
        else:
            ok.append(b)
    return ok, missing


#: configurations whose small jobs are submitted at the same time
AT_ONCE = 8


def side_by_side(spark: SparkSession, work: Callable, of: Iterable) -> list:
    """``work`` of each, in their order. Its jobs are too small to fill a cluster one after another."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), of))


def fused(features: DataFrame, spec: str) -> DataFrame:
    """(path, y, role, features) of one fusion spec, written once for its many readers."""
    roles = features.select("path", "role").distinct()
    return write_and_read(joins.fuse_blocks(features, spec).join(roles, "path"), "fused")


def prepared(rows: DataFrame, mode: str, pca: float, dims: list[int] | None, fit_role="train"):
    """Representation fitted on train rows and applied to all."""
    rep = fit_representation(rows.where(F.col("role") == fit_role), mode, pca, dims)
    z = write_and_read(rep.apply(rows), "represented")
    return rep, z


RULES = ["argmax", "threshold", "bayes", "bayes_cal"]


def scored(posts: DataFrame, k: int, normal_idx: int | None, thresholds: DataFrame | None = None) -> DataFrame:
    """One row for each candidate of ``posts`` (candidate, path, y_true, p): thresholds, temperature, calibration and the scores of
    the best of four rules, all candidates in the same passes. ``thresholds`` (candidate, th) stand instead of tuned ones.

    Best is the highest balanced accuracy at six decimals, then the lowest expected risk, then the first rule.
    """
    key = ["candidate"]
    tuned = selection.tune_thresholds(posts, key, k).groupBy("candidate").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cls", "threshold"))), lambda s: s["threshold"]).alias("tuned"))
    given = thresholds if thresholds is not None else posts.sparkSession.createDataFrame([], "candidate int, th array<double>")
    settings = tuned.join(given, key, "left").join(selection.temperature_fit(posts, key).select("candidate", "temperature"), key).select(
        "candidate", F.coalesce("th", "tuned").alias("thresholds"), "temperature")
    settings = write_and_read(settings, "candidate-settings")
    d = posts.join(F.broadcast(settings), key)  # one row for each candidate
    decided = selection.decision_rules(d.withColumn("method", F.col("candidate")), F.col("thresholds"), k, normal_idx, F.col("temperature"))
    by = ["candidate", "rule"]
    cm = write_and_read(decided.select(F.col("method").alias("candidate"), "rule", "y_true", F.col("decision").alias("y_pred"))
                        .groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")), "candidate-rules")
    codes = posts.sparkSession.range(k).select(F.col("id").cast("int").alias("y_true"))
    report = me.metrics_full_report(cm, by, k).join(me.expected_risk(cm, by, selection.cost_table(codes, normal_idx)), by)
    place = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    best = report.groupBy("candidate").agg(
        F.max_by(F.struct(F.col("rule").alias("decision_rule"), F.col("balanced_accuracy").alias("rule_bal_acc"), F.col("expected_risk").alias("rule_exp_risk")),
                 F.struct(F.round("balanced_accuracy", 6), -F.col("expected_risk"), -place)).alias("b")).select("candidate", "b.*")
    plain = report.where("rule = 'argmax'").select("candidate", F.col("accuracy").alias("valid_acc"), F.col("balanced_accuracy").alias("valid_bal_acc"),
                                                   F.col("f1_macro").alias("valid_f1"))
    raw = me.ece(posts, key, k).withColumnRenamed("ece", "ece_raw")
    cal = me.ece(d.select("candidate", "y_true", po.temperature_apply(F.col("p"), F.col("temperature"), k).alias("p")), key, k).withColumnRenamed("ece", "ece_cal")
    return plain.join(settings, key).join(raw, key).join(cal, key).join(best, key)


#: learners with a penalty; the others have one candidate for each spec and projection
PENALISED = ("logreg", "linsvm", "rbf")


def grid_posteriors(train: DataFrame, valid: DataFrame, learner: str, kwargs: dict, groups: int, cs: list[float], k: int,
                    blocks: DataFrame | None = None) -> DataFrame:
    """(grp, c, path, y, p) of one learner on all representations; ``candidate`` of the rows is the representation. All penalties of
    all representations are fitted in the same job or, for large ones, the same passes. ``blocks`` are the train rows in blocks."""
    if learner == "knn":
        def one(g: int) -> DataFrame:
            a, b = (d.where(F.col("candidate") == g).select("path", "y", "features") for d in (train, valid))
            return fit_head("knn", a, b, k, **kwargs).select(F.lit(g).alias("candidate"), "path", "y", "p")

        parts = reduce(DataFrame.unionByName, side_by_side(train.sparkSession, one, range(groups)))
    elif learner == "gbt":
        parts = boosting.boosted_posteriors(train, valid, k, boosting.Settings(**kwargs), blocks=blocks)
    elif learner == "linsvm":
        parts = linear.many_posteriors(train, valid, linear.LinearSvm(k, cs, **kwargs), blocks=blocks)
    elif learner in ("logreg", "rbf"):
        parts = linear.many_posteriors(train, valid, linear.Logistic(k, cs, fourier=(256, 42) if learner == "rbf" else None, **kwargs), blocks=blocks)
    else:
        raise ValueError(f"unknown grid learner {learner!r}")
    c = F.col("c") if learner in PENALISED else F.lit(float(cs[0]))
    return parts.select(F.col("candidate").alias("grp"), c.alias("c"), "path", "y", "p")


def grid_selection(features: DataFrame, specs: list[str], learners: dict[str, dict], pcas: list[float], cs: list[float],
                   k: int, normal_idx: int | None = None, standardize: str = "per_dim", ensemble: bool = True) -> DataFrame:
    """Spec x learner x (pca, C) grid, fitted on train and scored on validation only, and for each (spec, pca, C) an ensemble
    of all learners with weights searched on validation.

    ``fit_seconds`` is the learner's time over the number of its candidates; learners run side by side, so their times overlap: the
    last fits of one leave cores idle that another can use. A learner that fails stops the run: an
    incomplete grid must not be selected from.
    """
    spark = features.sparkSession
    data = side_by_side(spark, lambda spec: fused(features.where(F.col("role").isin("train", "valid")), spec), specs)
    asked = [(spec, d, pca) for spec, d in zip(specs, data) for pca in pcas]
    ready = side_by_side(spark, lambda a: prepared(a[1], standardize, a[2], None), asked)
    groups = [(spec, pca, rep.n_components, rep.explained) for (spec, _, pca), (rep, _) in zip(asked, ready)]
    rows = reduce(DataFrame.unionByName, [
        z.select(F.lit(i).alias("candidate"), "path", "y", "role", F.col("features").cast("array<double>").alias("features"), F.lit(1.0).alias("weight"))
        for i, (_, z) in enumerate(ready)])
    train, valid = (rows.where(F.col("role") == r).drop("role") for r in ("train", "valid"))
    posts, conf, number = None, [], {}
    blocks = to_blocks(train) if set(learners) - {"knn"} else None  # one copy for all learners

    def fitted(learner: str) -> tuple[DataFrame, float]:
        t = time.time()
        return write_and_read(grid_posteriors(train, valid, learner, learners[learner], len(groups), cs, k, blocks), f"grid-{learner}"), time.time() - t

    first = sorted(learners, key=lambda x: x != "gbt")  # the longest fits
    done = dict(zip(first, side_by_side(spark, fitted, first)))
    for learner in learners:
        own, seconds = done[learner]
        each = [(g, c) for g in range(len(groups)) for c in (cs if learner in PENALISED else cs[:1])]
        for g, c in each:
            number[learner, g, c] = len(conf)
            conf.append((len(conf), *groups[g][:1], learner, groups[g][1], float(c), *groups[g][2:], seconds / len(each), None))
        own = own.withColumn("learner", F.lit(learner))
        posts = own if posts is None else posts.unionByName(own)
    names = sorted(learners)
    searched = None
    if ensemble and len(names) > 1:
        # learners without a penalty are members of each penalty's ensemble
        all_cs = F.array(*[F.lit(float(c)) for c in cs])
        members = posts.withColumn("c", F.explode(F.when(F.col("learner").isin(*PENALISED), F.array("c")).otherwise(all_cs)))
        at = F.col("grp") * len(cs) + F.array_position(all_cs, F.col("c")).cast("int") - 1
        members = members.select(at.cast("int").alias("candidate"), "grp", "c", F.col("learner").alias("method"), "path", F.col("y").alias("y_true"), "p")
        t = time.time()
        searched = write_and_read(weight_search(members, names, k), "grid-weights")
        found = {r["candidate"]: r for r in searched.collect()}
        for i, r in sorted(found.items()):
            g, c = divmod(i, len(cs))
            number["ens", g, cs[c]] = len(conf)
            conf.append((len(conf), groups[g][0], "ens", groups[g][1], float(cs[c]), *groups[g][2:], (time.time() - t) / len(found), r["weights"]))
        weight = F.get("weights", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("method")).cast("int") - 1)
        parts = members.join(F.broadcast(searched), "candidate").select("grp", "c", "path", "y_true", F.posexplode("p").alias("i", "x"), weight.alias("w"))
        mixed = parts.groupBy("grp", "c", "path", "y_true", "i").agg(F.sum(F.col("x") * F.col("w")).alias("x")).groupBy("grp", "c", "path", F.col("y_true").alias("y")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))
        posts = posts.unionByName(mixed.withColumn("learner", F.lit("ens")))
    ids = spark.createDataFrame([(n, learner, g, float(c)) for (learner, g, c), n in number.items()], "candidate int, learner string, grp int, c double")
    posts = write_and_read(posts.join(F.broadcast(ids), ["learner", "grp", "c"]).select("candidate", "path", F.col("y").alias("y_true"), "p"), "grid-posteriors")
    own = None
    if searched is not None:
        own = searched.select((F.col("candidate") / len(cs)).cast("int").alias("grp"), F.get(all_cs, F.col("candidate") % len(cs)).alias("c"), F.col("thresholds").alias("th")).join(
            ids.where("learner = 'ens'"), ["grp", "c"]).select("candidate", "th")
    table = spark.createDataFrame(conf, "candidate int, spec string, learner string, pca double, c double, n_components int, explained double, "
                                        "fit_seconds double, ensemble_weights array<double>")
    return table.join(scored(posts, k, normal_idx, own), "candidate").select(
        *table.columns[:-1], "valid_acc", "valid_bal_acc", "valid_f1", "temperature", "ece_raw", "ece_cal", "decision_rule", "rule_bal_acc", "rule_exp_risk",
        "thresholds", "ensemble_weights")


def baseline_table(features: DataFrame, baselines: list[Baseline], k: int, dims: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(results, predictions): one metrics row per baseline, with its setting in plain columns;
    baselines that cannot run keep a row whose status says why."""
    spark = features.sparkSession
    ok, missing = available(features, baselines)
    preds, done = None, []
    for b in ok:
        try:
            data = fused(features, b.spec)
            widths = [dims[x] for x in b.spec.split("+")]
            _, z = prepared(data, b.standardize, b.pca, widths)
            post = fit_head(b.head, z.where("role = 'train'").drop("role"), z.where("role = 'test'").drop("role"), k, **b.kwargs)
            p = write_and_read(post.select(F.lit(b.key).alias("method"), "path", F.col("y").alias("y_true"),
                                           po.argmax_lowest(F.col("p"), k).alias("y_pred"), "p"), "baseline")
        except Exception as e:  # of any learner; the others' rows are still wanted
            lines = str(e).strip().splitlines()
            missing.append((b.key, f"failed: {type(e).__name__}" + (f": {lines[0][:200]}" if lines else "")))
            continue
        done.append(b)
        preds = p if preds is None else preds.unionByName(p)
    ok = done
    conf = spark.createDataFrame([(b.key, b.spec, b.head, b.standardize, b.pca) for b in baselines],
                                 "method string, spec string, head string, standardize string, pca double")
    status = spark.createDataFrame([(b.key, "ok") for b in ok] + missing, "method string, status string")
    out = conf.join(status, "method")
    if preds is not None:
        m = me.metrics_full_report(me.confusion_counts(preds, ["method"]), ["method"], k)
        out = out.join(m, "method", "left")
    return out, preds


def cv_evaluate(rows: DataFrame, folds: DataFrame, k: int, head: str = "logreg", kwargs: dict | None = None,
                standardize: str = "per_dim", pca: float = 0.0, normal_idx: int | None = None) -> DataFrame:
    """Refit scaling, projection and head per fold over train and valid rows; one row per fold
    and a summary row with mean, sample SD, min and max.

    ``rows`` is (path, y, features), ``folds`` is (fold, path, role).
    """
    ids = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    parts = None
    for f in ids:
        data = rows.join(folds.where(F.col("fold") == f).select("path", "role"), "path")
        _, z = prepared(data, standardize, pca, None)
        post = fit_head(head, z.where("role = 'train'").drop("role"), z.where("role = 'valid'").drop("role"), k, **(kwargs or {}))
        p = post.select(F.lit(f).alias("fold"), F.col("y").alias("y_true"), po.argmax_lowest(F.col("p"), k).alias("y_pred"))
        parts = p if parts is None else parts.unionByName(p)
    parts = write_and_read(parts, "cv")
    cm = me.confusion_counts(parts, ["fold"])
    cost = selection.cost_table(rows.select(F.col("y").alias("y_true")).distinct(), normal_idx)
    m = me.metrics_full_report(cm, ["fold"], k).join(me.expected_risk(cm, ["fold"], cost), "fold")
    per_fold = m.select(F.lit("cv_fold").alias("kind"), "fold", F.col("accuracy").alias("acc"), F.col("balanced_accuracy").alias("bal_acc"),
                        F.col("f1_macro").alias("f1"), F.col("expected_risk").alias("exp_risk"))
    s = per_fold.agg(F.lit("cv_summary").alias("kind"), F.lit(-1).alias("fold"), F.avg("acc").alias("acc"), F.avg("bal_acc").alias("bal_acc"),
                     F.avg("f1").alias("f1"), F.avg("exp_risk").alias("exp_risk"), F.stddev_samp("acc").alias("acc_std"), F.min("acc").alias("acc_min"),
                     F.max("acc").alias("acc_max"), F.stddev_samp("bal_acc").alias("bal_acc_std"))
    return per_fold.unionByName(s, allowMissingColumns=True)


def save_artifact(spark: SparkSession, path: str, rep, model, thresholds: list[float], meta: dict[str, str]) -> None:
    """Representation, model and metadata as one folder: a parquet row of vectors, the Spark ML
    model, and a JSON row. The target must not exist."""
    comp = [] if rep.components is None else [[float(x) for x in r] for r in rep.components]
    centre = [] if rep.centre is None else [float(x) for x in rep.centre]
    row = [(rep.mode, [float(x) for x in rep.mean], [float(x) for x in rep.sd], centre, comp, rep.explained)]
    spark.createDataFrame(row, "mode string, mean array<double>, sd array<double>, centre array<double>, components array<array<double>>, explained double"
                          ).coalesce(1).write.mode("errorifexists").parquet(path + "/representation")
    model.write().save(path + "/model")
    info = [(sorted(meta.items()), [float(t) for t in thresholds])]
    spark.createDataFrame(info, "meta array<struct<key:string,value:string>>, thresholds array<double>").select(
        F.map_from_entries("meta").alias("meta"), "thresholds").write.mode("errorifexists").json(path + "/metadata")


def load_artifact(spark: SparkSession, path: str):
    """(representation, model, thresholds, meta) written by ``save_artifact``."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegressionModel

    from assay.operators.features import Representation

    r = spark.read.parquet(path + "/representation").first()
    comp = np.asarray(r["components"]) if r["components"] else None
    rep = Representation(r["mode"], np.asarray(r["mean"]), np.asarray(r["sd"]), np.asarray(r["centre"]) if comp is not None else None,
                         comp, r["explained"])
    m = spark.read.schema("meta map<string,string>, thresholds array<double>").json(path + "/metadata").first()
    return rep, LogisticRegressionModel.load(path + "/model"), m["thresholds"], m["meta"]
