"""Registered queries over the prediction table: metrics, rules, pooling, paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.functions import posterior as po
from assay.operators import audits, joins, metrics as me, selection, tests_paired as tp
from assay.plans import fixtures as fx
from assay.plans.registry import NA, cte, query

K = fx.K
NORMAL = 2
THRESHOLDS = [0.3, 0.55, 0.25, 0.6]


def r6(df: DataFrame, *skip: str) -> DataFrame:
    """Round every double to 6 decimals, so that sums in another order compare equal."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def sql_per_class(cm: str, keys: str) -> str:
    return f"""(SELECT {keys}, cls, sum(tp) AS tp, sum(a) AS a, sum(p) AS p FROM (
SELECT {keys}, y_true AS cls, CASE WHEN y_true=y_pred THEN n ELSE 0 END AS tp, n AS a, 0 AS p FROM {cm}
UNION ALL SELECT {keys}, y_pred, 0, 0, n FROM {cm}) GROUP BY {keys}, cls)"""


def sql_metrics(cm: str, keys: str, k: int = K, prefix: str = "") -> str:
    """SQL text: accuracy, balanced accuracy, macro F1 per key from a confusion table."""
    return f"""SELECT {keys}, sum(tp)/sum(a)::DOUBLE AS {prefix}accuracy,
sum(CASE WHEN a>0 THEN tp::DOUBLE/a ELSE 0 END)/{k} AS {prefix}balanced_accuracy,
sum(CASE WHEN a+p>0 THEN 2*tp::DOUBLE/(a+p) ELSE 0 END)/{k} AS {prefix}macro_f1
FROM {sql_per_class(cm, keys)} GROUP BY {keys}"""


def sql_r6(select: str, plain: str, rounded: str) -> str:
    cols = ", ".join([plain] + [f"round({c.strip()},6) AS {c.strip()}" for c in rounded.split(",")])
    return f"SELECT {cols} FROM ({select})"


M3 = "accuracy,balanced_accuracy,macro_f1"
CM = "(SELECT method, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL)"
CMF = "(SELECT method, fold, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL)"


@query("confusion_counts", "SELECT method, fold, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL", ("preds",))
def _(spark, sf):
    return me.confusion_counts(fx.preds(spark, sf), ["method", "fold"])


@query("metrics_acc_bal_f1", sql_r6(sql_metrics(CM, "method"), "method", M3), ("preds",))
def _(spark, sf):
    return r6(me.metrics_from_confusion(me.confusion_counts(fx.preds(spark, sf), ["method"]), ["method"], K))


@query("metrics_strict", f"""SELECT method, round(sum(tp)/sum(a)::DOUBLE,6) AS accuracy, round(avg(r),6) AS balanced_accuracy,
round(avg(CASE WHEN pr+r>0 THEN 2*pr*r/(pr+r) ELSE 0 END),6) AS macro_f1 FROM (
SELECT *, tp::DOUBLE/a AS r, CASE WHEN p>0 THEN tp::DOUBLE/p ELSE 0 END AS pr FROM {sql_per_class(CM, "method")}) GROUP BY method""", ("preds",))
def _(spark, sf):
    return r6(me.metrics_strict(me.confusion_counts(fx.preds(spark, sf), ["method"]), ["method"], K))


_PC = f"""SELECT method, cls, tp, a, p, CASE WHEN p>0 THEN tp::DOUBLE/p ELSE 0 END AS pr,
CASE WHEN a>0 THEN tp::DOUBLE/a ELSE 0 END AS r FROM {sql_per_class(CM, "method")}"""


@query("metrics_per_class", f"""SELECT method, cls, round(pr,6) AS precision, round(r,6) AS recall,
round(CASE WHEN pr+r>0 THEN 2*pr*r/(pr+r) ELSE 0 END,6) AS f1, round(CASE WHEN a>0 THEN (a-tp)::DOUBLE/a ELSE 0 END,6) AS fnr,
CAST(a AS BIGINT) AS support FROM ({_PC})""", ("preds",))
def _(spark, sf):
    return r6(me.metrics_per_class(me.confusion_counts(fx.preds(spark, sf), ["method"]), ["method"]))


@query("metrics_full_report", f"""SELECT method, round(sum(tp)/sum(a)::DOUBLE,6) AS accuracy,
round(avg(CASE WHEN a>0 THEN r END),6) AS balanced_accuracy,
round(avg(CASE WHEN pr+r>0 THEN 2*pr*r/(pr+r) ELSE 0 END),6) AS f1_macro, round(avg(pr),6) AS precision_macro,
round(avg(r),6) AS recall_macro, round(sum(CASE WHEN a>0 THEN (a-tp)::DOUBLE/a ELSE 0 END)/{K},6) AS fnr_macro
FROM ({_PC}) GROUP BY method""", ("preds",))
def _(spark, sf):
    return r6(me.metrics_full_report(me.confusion_counts(fx.preds(spark, sf), ["method"]), ["method"], K))


def _binary(p: DataFrame) -> DataFrame:
    return p.withColumn("y_true", (F.col("y_true") != NORMAL).cast("int")).withColumn(
        "y_pred", (F.col("y_pred") != NORMAL).cast("int"))


@query("metrics_binary_cells", f"""SELECT method, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
round((tn+tp)/(tn+fp+fn+tp)::DOUBLE,6) AS accuracy, round(2*tp/(2*tp+fp+fn)::DOUBLE,6) AS f1_pos,
round(tp/(tp+fp)::DOUBLE,6) AS precision_pos, round(tp/(tp+fn)::DOUBLE,6) AS recall_pos FROM (
SELECT method, sum((y_true={NORMAL} AND y_pred={NORMAL})::INT) AS tn, sum((y_true={NORMAL} AND y_pred<>{NORMAL})::INT) AS fp,
sum((y_true<>{NORMAL} AND y_pred={NORMAL})::INT) AS fn, sum((y_true<>{NORMAL} AND y_pred<>{NORMAL})::INT) AS tp FROM preds GROUP BY method)""", ("preds",))
def _(spark, sf):
    cm = me.confusion_counts(_binary(fx.preds(spark, sf)), ["method"])
    return r6(me.metrics_full_report(cm, ["method"], 2)).select(
        "method", "tn", "fp", "fn", "tp", "accuracy", "f1_pos", "precision_pos", "recall_pos")


@query("miss_rate_presence", f"""SELECT method, round(avg((y_pred={NORMAL})::INT),6) AS fnr_presence
FROM preds WHERE y_true<>{NORMAL} GROUP BY method""", ("preds",))
def _(spark, sf):
    return r6(me.miss_rate_presence(fx.preds(spark, sf), ["method"], NORMAL))


@query("type_error_rate", f"""SELECT method, round(avg((y_pred<>y_true AND y_pred<>{NORMAL})::INT),6) AS type_error_rate
FROM preds WHERE y_true<>{NORMAL} GROUP BY method""", ("preds",))
def _(spark, sf):
    return r6(me.type_error_rate(fx.preds(spark, sf), ["method"], NORMAL))


COST_SQL = f"""CASE WHEN i=j THEN 0 WHEN i<>{NORMAL} AND j={NORMAL} THEN 10 WHEN i={NORMAL} AND j<>{NORMAL} THEN 1 ELSE 4 END::DOUBLE"""


@query("cost_matrix", f"""SELECT i AS y_true, j AS y_pred, {COST_SQL} AS cost
FROM (SELECT DISTINCT y_true AS i FROM preds), (SELECT DISTINCT y_true AS j FROM preds)""", ("preds",))
def _(spark, sf):
    return selection.cost_table(fx.preds(spark, sf).select("y_true").distinct(), NORMAL)


@query("expected_risk", f"""SELECT method, round(avg({COST_SQL.replace('i', 'y_true', 0)}),6) AS expected_risk
FROM (SELECT method, y_true AS i, y_pred AS j FROM preds) GROUP BY method""", ("preds",))
def _(spark, sf):
    p = fx.preds(spark, sf)
    cost = selection.cost_table(p.select("y_true").distinct(), NORMAL)
    return r6(me.expected_risk(me.confusion_counts(p, ["method"]), ["method"], cost))


ARG = "(list_position(list_transform(p, lambda x: x>=list_max(p)-1e-12), true)-1)"


@query("ece", f"""SELECT method, round(sum(m/t::DOUBLE*abs(acc-conf)),6) AS ece FROM (
SELECT method, bin, count(*) AS m, avg(ok) AS acc, avg(conf) AS conf, sum(count(*)) OVER (PARTITION BY method) AS t FROM (
SELECT method, conf, ok, len(list_filter(range(1,15), lambda i: conf > i*(1.0::DOUBLE/15))) AS bin FROM (
SELECT method, list_max(p) AS conf, ({ARG}=y_true)::INT AS ok FROM preds)) GROUP BY method, bin) GROUP BY method""", ("preds",))
def _(spark, sf):
    return r6(me.ece(fx.preds(spark, sf), ["method"], K))


SQL_FOLDS = f"""SELECT m.method, m.fold, round(accuracy,6) AS accuracy, round(balanced_accuracy,6) AS balanced_accuracy,
round(macro_f1,6) AS macro_f1, images, patients FROM ({sql_metrics(CMF, "method, fold")}) m
JOIN (SELECT method, fold, count(*) AS images, count(DISTINCT patient_id) AS patients FROM preds GROUP BY ALL) s
ON m.method=s.method AND m.fold=s.fold"""


@query("fold_metrics", SQL_FOLDS, ("preds",))
def _(spark, sf):
    return r6(me.fold_metrics(fx.preds(spark, sf), K))


def sql_mean_sd() -> str:
    agg = ", ".join(f"round(avg({m}),6) AS {m}_mean, round(stddev_samp({m}),6) AS {m}_sd" for m in me.METRICS)
    pooled = ", ".join(f"round({m},6) AS {m}_pooled_oof" for m in me.METRICS)
    return f"""SELECT a.*, b.* EXCLUDE (method) FROM (SELECT method, {agg} FROM ({sql_metrics(CMF, "method, fold")}) GROUP BY method) a
JOIN (SELECT method, {pooled} FROM ({sql_metrics(CM, "method")})) b ON a.method=b.method"""


@query("fold_mean_sd", sql_mean_sd(), ("preds",))
def _(spark, sf):
    return r6(me.fold_mean_sd(fx.preds(spark, sf), K))


@query("cv_summary", sql_mean_sd(), ("preds",))
def _(spark, sf):
    from assay.plans.reports import cv_summary
    return r6(cv_summary(fx.preds_table(spark, sf), K)["summary"])


@query("group_majority_label", """SELECT patient_id, CAST(arg_min(y_pred, (-n, y_pred)) AS INT) AS y_pred FROM (
SELECT patient_id, y_pred, count(*) AS n FROM preds GROUP BY ALL) GROUP BY patient_id""", ("preds",))
def _(spark, sf):
    return me.group_majority_label(fx.preds(spark, sf), "patient_id", "y_pred")


SQL_VOTE = """SELECT method, patient_id, arg_max(y_pred, (n,-y_pred)) AS y_pred, CAST(sum(n) AS BIGINT) AS slices,
count(*) FILTER (WHERE n=mx)>1 AS tie FROM (SELECT *, max(n) OVER (PARTITION BY method, patient_id) AS mx FROM (
SELECT method, patient_id, y_pred, count(*) AS n FROM preds GROUP BY ALL)) GROUP BY method, patient_id"""


@query("majority_vote", SQL_VOTE, ("preds",))
def _(spark, sf):
    return me.majority_vote(fx.preds(spark, sf))


SQL_MEANP = f"""SELECT method, patient_id, {ARG}::INT AS y_pred, slices, p,
len(list_filter(p, lambda x: x>=list_max(p)-1e-12))>1 AS tie FROM (
SELECT method, patient_id, [avg(p_0),avg(p_1),avg(p_2),avg(p_3)] AS p, count(*) AS slices FROM preds GROUP BY ALL)"""


def sql_nano_cols() -> str:
    return ", ".join(NA(f"p[{i + 1}]") + f" AS p_{i}" for i in range(K))


def nano_cols() -> list:
    return [po.nanos(F.get("p", F.lit(i))).alias(f"p_{i}") for i in range(K)]


@query("mean_posterior_pool", f"SELECT method, patient_id, y_pred, slices, tie, {sql_nano_cols()} FROM ({SQL_MEANP})", ("preds",))
def _(spark, sf):
    d = me.mean_posterior_pool(fx.preds(spark, sf), ["method", "patient_id"], K, renormalise=True)
    return d.select("method", "patient_id", "y_pred", "slices", "tie", *nano_cols())


@query("class_balance_weights", f"""SELECT y_true, n, round(t/({K}*n::DOUBLE),6) AS weight FROM (
SELECT y_true, count(*) AS n, sum(count(*)) OVER () AS t FROM preds GROUP BY y_true)""", ("preds",))
def _(spark, sf):
    return r6(me.class_balance_weights(fx.preds(spark, sf), "y_true"))


@query("confidence_weights", f"""SELECT method, path, {NA("w/avg(w) OVER ()")} AS weight_nanos FROM (
SELECT method, path, power(1-p[y_true+1],2)*CASE WHEN y_true<>{NORMAL} THEN 5.0 ELSE 1.0 END::DOUBLE AS w FROM preds)""", ("preds",))
def _(spark, sf):
    d = me.confidence_weights(fx.preds(spark, sf), NORMAL)
    return d.select("method", "path", po.nanos(F.col("weight")).alias("weight_nanos"))


SQL_VALIDATE = """SELECT 'missing_value' AS rule, count(*) FILTER (WHERE fold IS NULL OR method IS NULL OR path IS NULL OR patient_id IS NULL OR y_true IS NULL OR y_pred IS NULL) AS violations FROM {t}
UNION ALL SELECT 'blank_identifier', count(*) FILTER (WHERE trim(patient_id)='' OR trim(path)='' OR trim(method)='') FROM {t}
UNION ALL SELECT 'noninteger_code', count(*) FILTER (WHERE fold<>floor(fold) OR y_true<>floor(y_true) OR y_pred<>floor(y_pred)) FROM {t}
UNION ALL SELECT 'repeated_method_path', count(*) FROM (SELECT 1 FROM {t} GROUP BY method, path HAVING count(*)>1)
UNION ALL SELECT 'group_crosses_folds', count(*) FROM (SELECT 1 FROM {t} GROUP BY patient_id HAVING count(DISTINCT fold)>1)
UNION ALL SELECT 'group_crosses_labels', count(*) FROM (SELECT 1 FROM {t} GROUP BY patient_id HAVING count(DISTINCT y_true)>1)
UNION ALL SELECT 'path_in_two_groups', count(*) FROM (SELECT 1 FROM {t} GROUP BY path HAVING count(DISTINCT patient_id)>1)
UNION ALL SELECT 'codes_not_dense', CASE WHEN min(y_true)=0 AND max(y_true)=count(DISTINCT y_true)-1 THEN 0 ELSE 1 END FROM {t}
UNION ALL SELECT 'unknown_predicted_label', count(*) FILTER (WHERE y_pred NOT IN (SELECT DISTINCT y_true FROM {t})) FROM {t}"""


@query("validate_predictions", SQL_VALIDATE.format(t="preds"), ("preds",))
def _(spark, sf):
    return audits.validate_predictions(fx.preds(spark, sf))


def spoil(p: DataFrame) -> DataFrame:
    """Predictions with one defect of each kind, spread by the row's own number."""
    n = F.expr("cast(substr(path, 2) as bigint)")
    d = p.withColumn("n", n)
    d = (d.withColumn("patient_id", F.when(F.col("n") % 101 == 0, " ").otherwise(F.col("patient_id")))
         .withColumn("fold", F.when(F.col("n") % 103 == 0, F.col("fold") % 5 + 1).otherwise(F.col("fold")))
         .withColumn("y_pred", F.when(F.col("n") % 107 == 0, 9).otherwise(F.col("y_pred")))
         .withColumn("p", F.when(F.col("n") % 109 == 0, F.transform("p", lambda x: x * 1.6)).otherwise(F.col("p"))))
    return d.unionByName(d.where("n % 113 = 0")).drop("n")


SQL_SPOIL0 = """(SELECT method, path, y_true, CASE WHEN n%101=0 THEN ' ' ELSE patient_id END AS patient_id,
CAST(CASE WHEN n%103=0 THEN fold%5+1 ELSE fold END AS INT) AS fold, CAST(CASE WHEN n%107=0 THEN 9 ELSE y_pred END AS INT) AS y_pred,
CASE WHEN n%109=0 THEN list_transform(p, lambda x: x*1.6::DOUBLE) ELSE p END AS p, n FROM (SELECT *, substr(path,2)::BIGINT AS n FROM preds))"""
SQL_SPOIL = f"(SELECT * FROM {SQL_SPOIL0} UNION ALL SELECT * FROM {SQL_SPOIL0} WHERE n%113=0)"


@query("validate_predictions_defects", SQL_VALIDATE.format(t=SQL_SPOIL), ("preds",))
def _(spark, sf):
    return audits.validate_predictions(spoil(fx.preds(spark, sf)))


@query("validate_probabilities", f"""SELECT 'wrong_length' AS rule, count(*) FILTER (WHERE len(p)<>{K}) AS violations FROM {SQL_SPOIL}
UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE len(list_filter(p, lambda x: x IS NULL OR isnan(x) OR isinf(x)))>0) FROM {SQL_SPOIL}
UNION ALL SELECT 'negative', count(*) FILTER (WHERE list_min(p)<0) FROM {SQL_SPOIL}
UNION ALL SELECT 'sum_not_one', count(*) FILTER (WHERE abs(list_sum(p)-1)>2e-5) FROM {SQL_SPOIL}
UNION ALL SELECT 'label_not_argmax', count(*) FILTER (WHERE coalesce(abs(p[y_pred+1]-list_max(p))>1e-6+1e-5*list_max(p), true)) FROM {SQL_SPOIL}""", ("preds",))
def _(spark, sf):
    return audits.validate_posteriors(spoil(fx.preds(spark, sf)), K)


SQL_ALIGN = """SELECT m.method, count(*) FILTER (WHERE p.path IS NULL) AS missing, count(*) FILTER (WHERE r.path IS NULL) AS extra,
count(*) FILTER (WHERE p.path IS NOT NULL AND r.path IS NOT NULL AND NOT (p.patient_id=r.patient_id AND p.fold=r.fold AND p.y_true=r.y_true)) AS different
FROM (SELECT DISTINCT method FROM {t} WHERE method<>'{ref}') m, """


@query("align_methods", f"""WITH d AS (SELECT * FROM preds WHERE NOT (method='vit_rf' AND {"substr(path,2)::BIGINT"}%97=0)),
r AS (SELECT * FROM d WHERE method='proposed'), q AS (SELECT * FROM d WHERE method<>'proposed')
SELECT method, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(extra) AS BIGINT) AS extra, CAST(sum(different) AS BIGINT) AS different FROM (
SELECT m.method, (q.path IS NULL)::INT AS missing, 0 AS extra,
coalesce(NOT (q.patient_id=r.patient_id AND q.fold=r.fold AND q.y_true=r.y_true), false)::INT AS different
FROM r CROSS JOIN (SELECT DISTINCT method FROM q) m LEFT JOIN q ON q.method=m.method AND q.path=r.path
UNION ALL SELECT q.method, 0, 1, 0 FROM q WHERE path NOT IN (SELECT path FROM r)) GROUP BY method""".replace("WITH d AS", "SELECT * FROM (WITH d AS") + ")", ("preds",))
def _(spark, sf):
    p = fx.preds(spark, sf).where("not (method = 'vit_rf' and cast(substr(path, 2) as bigint) % 97 = 0)")
    return joins.align_methods(p, "proposed")


@query("paired_predictions", """SELECT a.path, a.patient_id, a.y_true, a.y_pred AS pred_a, b.y_pred AS pred_b
FROM preds a JOIN preds b ON a.path=b.path WHERE a.method='proposed' AND b.method='linear_probe'""", ("preds",))
def _(spark, sf):
    return joins.paired_predictions(fx.preds(spark, sf), "proposed", "linear_probe")


@query("paired_vs_baselines", """SELECT a.path, a.patient_id, a.y_true, a.y_pred AS pred_a, b.method AS baseline, b.y_pred AS pred_b
FROM preds a JOIN preds b ON a.path=b.path WHERE a.method='proposed' AND b.method<>'proposed'""", ("preds",))
def _(spark, sf):
    return joins.paired_vs_baselines(fx.preds(spark, sf), "proposed")


@query("argmax_lowest_index", f"""SELECT method, path, {ARG}::INT AS argmax, len(list_filter(p, lambda x: x>=list_max(p)-1e-12))>1 AS tie
FROM (SELECT method, path, list_transform(p, lambda x: round(x,1)) AS p FROM preds)""", ("preds",))
def _(spark, sf):
    p = fx.preds(spark, sf).withColumn("p", F.transform("p", lambda x: F.round(x, 1)))
    return p.select("method", "path", po.argmax_lowest(F.col("p"), K).alias("argmax"), po.has_tie(F.col("p"), K).alias("tie"))


@query("weighted_average_posteriors", f"""SELECT path, {", ".join(NA(f"0.5::DOUBLE*a.p_{i}+0.3::DOUBLE*b.p_{i}+0.2::DOUBLE*c.p_{i}") + f" AS p_{i}" for i in range(K))}
FROM (SELECT * FROM preds WHERE method='proposed') a JOIN (SELECT * FROM preds WHERE method='linear_probe') b USING (path)
JOIN (SELECT * FROM preds WHERE method='vit_rf') c USING (path)""", ("preds",))
def _(spark, sf):
    d = joins.ensemble_posteriors(fx.preds(spark, sf), {"proposed": 0.5, "linear_probe": 0.3, "vit_rf": 0.2}, K)
    return d.select("path", *nano_cols())


SQL_T = "[" + ",".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]"
SQL_SC = f"list_transform(p, lambda x, i: CASE WHEN x>=({SQL_T})[i] THEN x/({SQL_T})[i] ELSE -1.0::DOUBLE END)"
SQL_THR = f"""CASE WHEN list_max({SQL_SC})>0 THEN list_position(list_transform({SQL_SC}, lambda s: s>=list_max({SQL_SC})-1e-12), true)-1 ELSE {ARG} END::INT"""


def sql_bayes(p: str) -> str:
    cost = po.cost_matrix(K, NORMAL)
    risk = "[" + ",".join("+".join(f"{p}[{i + 1}]*{cost[i][j]}::DOUBLE" for i in range(K)) for j in range(K)) + "]"
    return f"(list_position(list_transform({risk}, lambda x: x<=list_min({risk})+1e-12), true)-1)::INT"


TEMP = 1.7
SQL_Z = f"list_transform(p, lambda x: ln(greatest(1e-12,least(1.0::DOUBLE,x)))/{TEMP}::DOUBLE)"
SQL_CAL = f"""(SELECT * EXCLUDE (e), list_transform(e, lambda x: x/list_sum(e)) AS pc FROM (
SELECT *, list_transform(z, lambda x: exp(x-list_max(z))) AS e FROM (SELECT *, {SQL_Z} AS z FROM preds)))"""


@query("threshold_rule", f"SELECT method, path, {SQL_THR} AS decision FROM preds", ("preds",))
def _(spark, sf):
    return fx.preds(spark, sf).select("method", "path", po.threshold_rule(F.col("p"), THRESHOLDS, K, NORMAL).alias("decision"))


@query("bayes_rule", f"SELECT method, path, {sql_bayes('p')} AS decision FROM preds", ("preds",))
def _(spark, sf):
    return fx.preds(spark, sf).select("method", "path", po.bayes_rule(F.col("p"), po.cost_matrix(K, NORMAL)).alias("decision"))


@query("temperature_apply", f"SELECT method, path, {', '.join(NA(f'pc[{i + 1}]') + f' AS p_{i}' for i in range(K))} FROM {SQL_CAL}", ("preds",))
def _(spark, sf):
    d = fx.preds(spark, sf).withColumn("p", po.temperature_apply(F.col("p"), TEMP, K))
    return d.select("method", "path", *nano_cols())


@query("decision_rules_all", f"""SELECT method, rule, decision, count(*) AS n FROM (
SELECT method, 'argmax' AS rule, {ARG}::INT AS decision FROM preds
UNION ALL SELECT method, 'threshold', {SQL_THR} FROM preds
UNION ALL SELECT method, 'bayes', {sql_bayes('p')} FROM preds
UNION ALL SELECT method, 'bayes_cal', {sql_bayes('pc')} FROM {SQL_CAL}) GROUP BY ALL""", ("preds",))
def _(spark, sf):
    d = selection.decision_rules(selection.distinct_posteriors(fx.preds(spark, sf), ["method"]), THRESHOLDS, K, NORMAL, TEMP, ("n",))
    return d.groupBy("method", "rule", "decision").agg(F.sum("n").alias("n"))


SQL_PAIR = "(SELECT a.*, b.y_pred AS yb, b.method AS base FROM preds a JOIN preds b ON a.path=b.path WHERE a.method='proposed' AND b.method<>'proposed')"


def sql_mcnemar(src: str, keys: str) -> str:
    """SQL text: exact two-sided binomial p over discordant pairs, by summing log terms."""
    return f"""SELECT {keys}, ab AS a_correct_b_wrong, ba AS a_wrong_b_correct, ab+ba AS discordant,
CASE WHEN ab+ba=0 THEN 1.0 ELSE least(1.0, round(2*list_sum(list_transform(range(0,least(ab,ba)+1), lambda i:
exp(lgamma(ab+ba+1)-lgamma(i+1)-lgamma(ab+ba-i+1)-(ab+ba)*ln(2.0::DOUBLE)))),6)) END::DOUBLE AS p_exact_two_sided FROM (
SELECT {keys}, count(*) FILTER (WHERE y_pred=y_true AND yb<>y_true) AS ab, count(*) FILTER (WHERE y_pred<>y_true AND yb=y_true) AS ba
FROM {src} GROUP BY {keys})"""


@query("exact_mcnemar", sql_mcnemar(SQL_PAIR, "base").replace("SELECT base, ab", "SELECT base AS baseline, ab"), ("preds",))
def _(spark, sf):
    pairs = joins.paired_vs_baselines(fx.preds(spark, sf), "proposed")
    return r6(tp.exact_mcnemar(pairs, ["baseline"]))


SQL_UNITS = f"""(SELECT 'slice_IID_DIAGNOSTIC_ONLY' AS unit, y_true, y_pred, yb FROM {SQL_PAIR} WHERE base='linear_probe'
UNION ALL SELECT 'identifier_majority_vote', t.y_true, a.y_pred, b.y_pred FROM v a JOIN v b USING (patient_id) JOIN t USING (patient_id) WHERE a.method='proposed' AND b.method='linear_probe'
UNION ALL SELECT 'identifier_mean_probability', t.y_true, a.y_pred, b.y_pred FROM q a JOIN q b USING (patient_id) JOIN t USING (patient_id) WHERE a.method='proposed' AND b.method='linear_probe')"""
SQL_MCUNIT = f"""SELECT * FROM (WITH v AS ({SQL_VOTE}), q AS ({SQL_MEANP}), t AS (SELECT DISTINCT patient_id, y_true FROM preds)
{sql_mcnemar(SQL_UNITS, "unit")})"""


@query("mcnemar_by_unit", SQL_MCUNIT, ("preds",))
def _(spark, sf):
    return r6(tp.mcnemar_by_unit(fx.preds(spark, sf), "proposed", "linear_probe", K))


SQL_FAM = f"""SELECT *, row_number() OVER (PARTITION BY base ORDER BY p, fold) AS rk, count(*) OVER (PARTITION BY base) AS m FROM (
SELECT base, fold, p_exact_two_sided AS p FROM ({sql_mcnemar(SQL_PAIR, "base, fold")}))"""


@query("holm_adjust", f"""SELECT base AS baseline, fold, p AS p_raw, round(max(least(1.0, (m-rk+1)*p)) OVER (PARTITION BY base ORDER BY rk),6) AS p_holm FROM ({SQL_FAM})""", ("preds",))
def _(spark, sf):
    p = fx.preds(spark, sf)
    folds = p.where("method = 'proposed'").select("path", "fold")
    pairs = joins.paired_vs_baselines(p, "proposed").join(folds, "path")
    raw = r6(tp.exact_mcnemar(pairs, ["baseline", "fold"])).select("baseline", "fold", F.col("p_exact_two_sided").alias("p_raw"))
    return r6(tp.holm_adjust(raw, ["baseline"], "p_raw", "fold"))


@query("leaderboard", """SELECT candidate, spec, learner, round(valid_bal_acc,6) AS valid_bal_acc, exp_risk FROM grid
ORDER BY grid.valid_bal_acc DESC, exp_risk, candidate LIMIT 20""", ("grid",))
def _(spark, sf):
    d = selection.leaderboard(fx.grid(spark, sf), [F.desc("valid_bal_acc"), F.asc("exp_risk"), F.asc("candidate")], 20)
    return r6(d.select("candidate", "spec", "learner", "valid_bal_acc", "exp_risk"), "exp_risk")


@query("select_best_config", """SELECT spec, arg_max(candidate, (valid_bal_acc, -candidate)) AS candidate, round(max(valid_bal_acc),6) AS valid_bal_acc FROM grid GROUP BY spec""", ("grid",))
def _(spark, sf):
    return r6(selection.select_best(fx.grid(spark, sf), ["spec"], "valid_bal_acc", "candidate"))


@query("select_decision_rule", """SELECT spec, learner, arg_max(candidate, (round(valid_bal_acc,6), -exp_risk, -candidate)) AS candidate FROM grid GROUP BY ALL""", ("grid",))
def _(spark, sf):
    return selection.select_by_score_then_risk(fx.grid(spark, sf), ["spec", "learner"], "valid_bal_acc", "exp_risk", "candidate")


SQL_GRIDT = "(SELECT i, round(0.05+i*0.025,3)::DOUBLE AS t FROM range(0,37) r(i))"
SQL_TUNE = """(SELECT {keys}, cls, arg_max(t, (v,-t)) AS threshold, max(v) AS score FROM (
SELECT {keys}, cls, t, (sum((y_true=cls AND pc>=t)::INT)/sum((y_true=cls)::INT)::DOUBLE + sum((y_true<>cls AND pc<t)::INT)/sum((y_true<>cls)::INT)::DOUBLE)/2 AS v
FROM (SELECT {keys}, y_true, unnest([0,1,2,3])::INT AS cls, round(unnest(p),9) AS pc FROM {src}), """ + SQL_GRIDT + """ GROUP BY {keys}, cls, t) GROUP BY {keys}, cls)"""


@query("threshold_tune", f"SELECT method, cls, threshold, round(score,6) AS score FROM {SQL_TUNE.format(keys='method', src='preds')}", ("preds",))
def _(spark, sf):
    return r6(selection.tune_thresholds(fx.preds(spark, sf), ["method"], K))


def sql_two(value: str, shown: str, enough: str) -> str:
    """Thresholds of two classes, class 0 normal: presence against absence."""
    return f"""SELECT method, cls, CASE WHEN cls=1 THEN t ELSE 0.5 END::DOUBLE AS threshold, round(shown,6) AS score FROM (
SELECT method, arg_max(t, (round({value},12), -t)) FILTER (WHERE {enough}) AS t, arg_max({shown}, (round({value},12), -t)) FILTER (WHERE {enough}) AS shown FROM (
SELECT method, t, count(*) FILTER (WHERE y_true>0)::DOUBLE AS p_, count(*) FILTER (WHERE y_true=0)::DOUBLE AS n_, count(*) FILTER (WHERE y_true>0 AND pc>=t)::DOUBLE AS tp, count(*) FILTER (WHERE y_true=0 AND pc>=t)::DOUBLE AS fp
FROM (SELECT method, y_true, round(p[2]+p[3]+p[4],9) AS pc FROM preds), """ + SQL_GRIDT + f""" GROUP BY method, t) GROUP BY method), (VALUES (0),(1)) c(cls)"""


_F1P, _F1N = "coalesce(2*tp/nullif(p_+tp+fp,0),0)", "coalesce(2*(n_-fp)/nullif(2*(n_-fp)+fp+p_-tp,0),0)"
_BAL = "(tp/p_+(n_-fp)/n_)/2"


def _presence(spark, sf):
    q = F.get("p", F.lit(1)) + F.get("p", F.lit(2)) + F.get("p", F.lit(3))
    return fx.preds(spark, sf).select("method", (F.col("y_true") > 0).cast("int").alias("y_true"), F.array(1 - q, q).alias("p"))


@query("threshold_tune_two_classes", " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM ({sql_two(v, s_, e)})" for m, v, s_, e in (
    ("bal_acc", _BAL, _BAL, "true"), ("f1_macro", f"({_F1P}+{_F1N})/2", f"({_F1P}+{_F1N})/2", "true"), ("f1_pos", _F1P, _BAL, "tp/p_>=0.97"))), ("preds",))
def _(spark, sf):
    d = _presence(spark, sf)
    out = None
    for metric, least in (("bal_acc", 0.0), ("f1_macro", 0.0), ("f1_pos", 0.97)):
        one = selection.tune_thresholds(d, ["method"], 2, metric, least, 0).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return r6(out.select("metric", "method", "cls", "threshold", "score"))


@query("early_stop_epoch", """SELECT run, arg_max(epoch, (score, -epoch)) AS chosen_epoch, round(max(score),6) AS best_score,
min(stop_epoch) AS stop_epoch FROM (SELECT *, min(CASE WHEN stale>=8 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM (
SELECT *, rn - max(CASE WHEN improved THEN rn ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) AS stale FROM (
SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS rn,
score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS improved FROM epochs)))
WHERE stop_epoch IS NULL OR epoch<=stop_epoch GROUP BY run""", ("epochs",))
def _(spark, sf):
    return r6(selection.early_stop(fx.epochs(spark, sf), ["run"], "epoch", "score", patience=8, width=100_000))


@query("temperature_fit")
def _(spark, sf):
    return selection.temperature_fit(fx.preds(spark, sf), ["method"])


SQL_W = """(SELECT a*11+b AS wid, a/10.0::DOUBLE AS w0, b/10.0::DOUBLE AS w1, (10-a-b)/10.0::DOUBLE AS w2 FROM range(0,11) x(a), range(0,11) y(b) WHERE a+b<=10
UNION ALL SELECT -1, 1/3.0::DOUBLE, 1/3.0::DOUBLE, 1/3.0::DOUBLE)"""


@query("ensemble_weight_search", f"""SELECT * FROM (WITH mem AS (SELECT a.path, a.y_true, a.p AS pa, b.p AS pb, c.p AS pc0 FROM (SELECT * FROM preds WHERE method='linear_probe') a
JOIN (SELECT * FROM preds WHERE method='proposed') b USING (path) JOIN (SELECT * FROM preds WHERE method='vit_rf') c USING (path)),
mix AS (SELECT wid, y_true, [{",".join(f"round(w0*pa[{i}]+w1*pb[{i}]+w2*pc0[{i}],9)" for i in range(1, 5))}] AS p FROM mem, {SQL_W}),
thr AS (SELECT wid, list(threshold ORDER BY cls) AS th FROM {SQL_TUNE.format(keys="wid", src="mix")} GROUP BY wid),
sc AS (SELECT wid, y_true, p, th, list_transform(p, lambda x, i: CASE WHEN x>=th[i] THEN x/th[i] ELSE -1.0::DOUBLE END) AS s FROM mix JOIN thr USING (wid)),
cm AS (SELECT wid, y_true, CASE WHEN list_max(s)>0 THEN list_position(list_transform(s, lambda x: x>=list_max(s)-1e-12), true)-1 ELSE {ARG} END AS y_pred, count(*) AS n FROM sc GROUP BY ALL),
res AS ({sql_metrics("cm", "wid")})
SELECT wid, round(balanced_accuracy,6) AS valid_score FROM res ORDER BY round(balanced_accuracy,9) DESC, wid LIMIT 1)""", ("preds",))
def _(spark, sf):
    return r6(selection.ensemble_weight_search(fx.preds(spark, sf), ["linear_probe", "proposed", "vit_rf"], K).select("wid", "valid_score"))


@query("merge_predictions", """SELECT fold, method, count(*) AS n FROM preds GROUP BY ALL""", ("preds",))
def _(spark, sf):
    p = fx.preds(spark, sf)
    wide = [joins.spread_posteriors(p.where(F.col("method") == m), K) for m, _ in fx.METHODS]
    merged = joins.merge_predictions([wide[0], wide[1], wide[2].drop("p_0", "p_1", "p_2", "p_3")])
    if any(c.startswith("p_") for c in merged.columns):
        raise ValueError("probability columns must be dropped when one input lacks them")
    return merged.groupBy("fold", "method").agg(F.count(F.lit(1)).alias("n"))


@query("union_folds", f"SELECT method, fold, path, y_pred, {NA('p_0')} AS p_0 FROM preds", ("preds",))
def _(spark, sf):
    p = joins.spread_posteriors(fx.preds(spark, sf), K)
    u = joins.union_folds([p.where(F.col("fold") == f) for f in range(1, 6)])
    return u.select("method", "fold", "path", "y_pred", po.nanos(F.col("p_0")).alias("p_0"))


@query("evaluate_report", f"""SELECT method, rule, round(accuracy,6) AS accuracy, round(balanced_accuracy,6) AS balanced_accuracy, round(macro_f1,6) AS macro_f1, level FROM (
{sql_metrics(f'''(SELECT method, rule, level, y_true, y_pred, count(*) AS n FROM (
SELECT method, 'argmax' AS rule, 'slice' AS level, y_true, {ARG}::INT AS y_pred FROM preds
UNION ALL SELECT method, 'threshold', 'slice', y_true, {SQL_THR} FROM preds
UNION ALL SELECT method, 'argmax', 'group', y_true, {ARG}::INT FROM g
UNION ALL SELECT method, 'threshold', 'group', y_true, {SQL_THR} FROM g) GROUP BY ALL)''', "method, rule, level")})""".replace(
    "FROM g", "FROM (SELECT method, patient_id, min(y_true) AS y_true, [avg(p_0),avg(p_1),avg(p_2),avg(p_3)] AS p FROM preds GROUP BY ALL)"), ("preds",))
def _(spark, sf):
    from assay.plans.reports import evaluate_report
    return r6(evaluate_report(fx.preds(spark, sf), THRESHOLDS, K, NORMAL))


_POOLED = "SELECT method, patient_id, min(y_true) AS y_true, [avg(p_0),avg(p_1),avg(p_2),avg(p_3)] AS p FROM preds GROUP BY ALL"
_CASES = f"(SELECT method, 'slice' AS level, patient_id, y_true, p FROM preds UNION ALL SELECT method, 'group', patient_id, y_true, p FROM ({_POOLED}))"
cte("cases", f"SELECT * FROM {SQL_CAL.replace('FROM preds', 'FROM ' + _CASES)}", "preds")
cte("reportcases", "SELECT method, level, rule, patient_id, y_true, y_pred FROM (" + " UNION ALL ".join(
    f"SELECT method, level, '{rule}' AS rule, patient_id, y_true, {text} AS y_pred FROM cases" for rule, text in (
        ("argmax", f"{ARG}::INT"), ("threshold", SQL_THR), ("bayes", sql_bayes("p")), ("bayes_cal", sql_bayes("pc")))) + ")", "cases")
_RK = "method, level, rule"
cte("reportrules", f"""SELECT *, accuracy-max(accuracy) FILTER (WHERE rule='argmax') OVER (PARTITION BY method, level) AS accuracy_gain FROM (
SELECT {_RK}, sum(tp)/sum(a)::DOUBLE AS accuracy, avg(CASE WHEN a>0 THEN r END) AS balanced_accuracy, avg(CASE WHEN pr+r>0 THEN 2*pr*r/(pr+r) ELSE 0 END) AS f1_macro,
avg(pr) AS precision_macro, avg(r) AS recall_macro, sum(CASE WHEN a>0 THEN (a-tp)::DOUBLE/a ELSE 0 END)/{K} AS fnr_macro FROM (
SELECT *, CASE WHEN p>0 THEN tp::DOUBLE/p ELSE 0 END AS pr, CASE WHEN a>0 THEN tp::DOUBLE/a ELSE 0 END AS r FROM
{sql_per_class(f"(SELECT {_RK}, y_true, y_pred, count(*) AS n FROM reportcases GROUP BY ALL)", _RK)}) GROUP BY {_RK}) JOIN (
SELECT {_RK}, count(*) AS n, avg({COST_SQL.replace("i=j", "y_true=y_pred").replace("i<>", "y_true<>").replace("i=", "y_true=").replace("j=", "y_pred=").replace("j<>", "y_pred<>")}) AS expected_risk,
avg((y_pred={NORMAL})::INT) FILTER (WHERE y_true<>{NORMAL}) AS fnr_presence, avg((y_pred<>y_true AND y_pred<>{NORMAL})::INT) FILTER (WHERE y_true<>{NORMAL}) AS type_error_rate
FROM reportcases GROUP BY {_RK}) USING ({_RK})""", "reportcases")


def report_parts(spark, sf):
    from assay.plans.reports import held_out_report
    return held_out_report(fx.preds_table(spark, sf), THRESHOLDS, K, NORMAL, TEMP)


@query("held_out_report", f"""SELECT {_RK}, {", ".join(f"round({c},6) AS {c}" for c in "accuracy balanced_accuracy f1_macro precision_macro recall_macro fnr_macro expected_risk fnr_presence type_error_rate accuracy_gain".split())},
CAST(n AS BIGINT) AS n, rule='threshold' AS selected FROM reportrules""", ("reportrules",))
def _(spark, sf):
    return r6(report_parts(spark, sf)["rules"])


@query("build_prediction_rows", f"""SELECT fold, method, path, patient_id, y_true, {ARG}::INT AS y_pred, {", ".join(NA(f"p_{i}") + f" AS p_{i}" for i in range(K))} FROM preds""", ("preds",))
def _(spark, sf):
    p = fx.preds(spark, sf).drop("y_pred")
    d = joins.build_prediction_rows(p, K)
    return d.select("fold", "method", "path", "patient_id", "y_true", "y_pred",
                    *[po.nanos(F.col(f"p_{i}")).alias(f"p_{i}") for i in range(K)])


@query("export_error_cases", f"""SELECT line FROM (SELECT 'TRUE='||y_true||chr(9)||'PRED='||y_pred||chr(9)||method||chr(9)||path AS line FROM preds WHERE y_true<>y_pred
UNION ALL SELECT 'MISSED'||chr(9)||'TRUE='||y_true||chr(9)||'PRED='||y_pred||chr(9)||method||chr(9)||path FROM preds WHERE y_true<>{NORMAL} AND y_pred={NORMAL})""", ("preds",))
def _(spark, sf):
    from assay.sources import sinks
    return sinks.export_error_cases(fx.preds(spark, sf), NORMAL)
