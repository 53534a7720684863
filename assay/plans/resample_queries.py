"""Registered resampling queries. The oracle repeats the draws in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import joins, metrics as me, resample as rs
from assay.plans import fixtures as fx
from assay.plans.metric_queries import ARG, K, SQL_MEANP, SQL_VOTE, r6, report_parts, sql_metrics, sql_mean_sd
from assay.plans.registry import H, cte, query

B = 2000
SEED = 42
METHODS = [m for m, _ in fx.METHODS]
P = rs.PRIME


def sql_mix(seed: int, rep: str, stratum: str, slot: str) -> str:
    s0 = f"(({rep})*1000003+({slot})*10007+({stratum})*101+{seed})%{P}"
    return s0


def sql_mixed(src: str, cols: str, seed: int, rep: str, stratum: str, slot: str, out: str) -> str:
    """SQL text: the residue column ``out`` added to ``src``, one squaring step per level."""
    a = f"SELECT {cols}, {sql_mix(seed, rep, stratum, slot)} AS s0 FROM {src}"
    b = f"SELECT *, (s0*48271+11)%{P} AS s1 FROM ({a})"
    c = f"SELECT *, (s1*s1+s0)%{P} AS s2 FROM ({b})"
    d = f"SELECT *, (s2*69621+17)%{P} AS s3 FROM ({c})"
    return f"(SELECT {cols}, (s3*s3+s1)%{P} AS {out} FROM ({d}))"


cte("gt", "SELECT patient_id, min(y_true)::BIGINT AS st FROM preds GROUP BY patient_id", "preds")
cte("ranked", "SELECT patient_id, st, row_number() OVER (PARTITION BY st ORDER BY patient_id)-1 AS rk, count(*) OVER (PARTITION BY st) AS n FROM gt", "gt")
cte("wts", f"""SELECT rep, patient_id, count(*) AS w FROM (SELECT rep, d.st, m*d.n//{P} AS rk FROM
{sql_mixed(f"(SELECT st, n, rk AS slot, rep FROM ranked, range(0,{B}) r(rep))", "rep, st, n, slot", SEED, "rep", "st", "slot", "m")} d) x
JOIN ranked g ON g.st=x.st AND g.rk=x.rk GROUP BY rep, patient_id""", "ranked")
cte("units", f"""SELECT method, 'slice_clustered' AS unit, patient_id, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL
UNION ALL SELECT v.method, 'majority_vote', v.patient_id, g.st::INT, v.y_pred, 1 FROM ({SQL_VOTE}) v JOIN gt g ON g.patient_id=v.patient_id
UNION ALL SELECT v.method, 'mean_probability', v.patient_id, g.st::INT, v.y_pred, 1 FROM ({SQL_MEANP}) v JOIN gt g ON g.patient_id=v.patient_id""", "preds", "gt")
cte("repcm", "SELECT rep, method, unit, y_true, y_pred, sum(w*n) AS n FROM wts JOIN units USING (patient_id) GROUP BY ALL", "wts", "units")
cte("repm", sql_metrics("repcm", "rep, method, unit", K), "repcm")
cte("pointm", sql_metrics("(SELECT method, unit, y_true, y_pred, sum(n) AS n FROM units GROUP BY ALL)", "method, unit", K), "units")


def sql_long(src: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {m} AS value FROM {src}" for m in me.METRICS)


@query("stratified_cluster_bootstrap", f"""SELECT p.method, p.unit, p.metric, round(p.value,6) AS estimate, round(lo,6) AS ci95_low, round(hi,6) AS ci95_high FROM ({sql_long("pointm", "method, unit")}) p
JOIN (SELECT method, unit, metric, quantile_cont(value,0.025) AS lo, quantile_cont(value,0.975) AS hi FROM ({sql_long("repm", "method, unit")}) GROUP BY ALL) c USING (method, unit, metric)""", ("repm", "pointm"))
def _(spark, sf):
    return r6(rs.stratified_cluster_bootstrap(fx.preds(spark, sf), METHODS, K, B, SEED))


SQL_D = ", ".join(f"a.{m}-b.{m} AS {m}" for m in me.METRICS)


SQL_PAIRED = f"""SELECT p.unit, p.metric, round(p.value,6) AS difference, round(lo,6) AS ci95_low, round(hi,6) AS ci95_high, 'proposed minus linear_probe' AS comparison FROM (
{sql_long(f"(SELECT unit, {SQL_D} FROM pointm a JOIN pointm b USING (unit) WHERE a.method='proposed' AND b.method='linear_probe')", "unit")}) p
JOIN (SELECT unit, metric, quantile_cont(value,0.025) AS lo, quantile_cont(value,0.975) AS hi FROM (
{sql_long(f"(SELECT rep, unit, {SQL_D} FROM repm a JOIN repm b USING (rep, unit) WHERE a.method='proposed' AND b.method='linear_probe')", "unit")}) GROUP BY ALL) c USING (unit, metric)"""


@query("paired_difference_ci", SQL_PAIRED, ("repm", "pointm"))
def _(spark, sf):
    return r6(rs.paired_difference_ci(fx.preds(spark, sf), "proposed", "linear_probe", K, B, SEED))


cte("ranked0", "SELECT patient_id, 0::BIGINT AS st, row_number() OVER (ORDER BY patient_id)-1 AS rk, count(*) OVER () AS n FROM gt", "gt")
cte("wts0", f"""SELECT rep, patient_id, count(*) AS w FROM (SELECT rep, m*d.n//{P} AS rk FROM
{sql_mixed(f"(SELECT st, n, rk AS slot, rep FROM ranked0, range(0,{B}) r(rep))", "rep, st, n, slot", SEED, "rep", "st", "slot", "m")} d) x
JOIN ranked0 g ON g.rk=x.rk GROUP BY rep, patient_id""", "ranked0")
cte("hits", "SELECT method, patient_id, sum((y_true=y_pred)::INT) AS h, count(*) AS n FROM preds GROUP BY ALL", "preds")


@query("cluster_bootstrap_accuracy", """SELECT method, round(avg(a),6) AS mean, round(quantile_cont(a,0.025),6) AS lo, round(quantile_cont(a,0.975),6) AS hi,
(SELECT count(*) FROM gt) AS n_units FROM (SELECT method, rep, sum(w*h)/sum(w*n)::DOUBLE AS a FROM hits JOIN wts0 USING (patient_id) GROUP BY ALL) GROUP BY method""", ("wts0", "hits", "gt"))
def _(spark, sf):
    return r6(rs.cluster_bootstrap_accuracy(fx.preds(spark, sf), METHODS, B, SEED))


_USED = "CASE WHEN level='group' AND accuracy_gain<=0 THEN 'argmax' ELSE 'threshold' END AS rule"
_ECE = lambda p, name: f"""SELECT method, sum(m/t::DOUBLE*abs(acc-conf)) AS {name} FROM (SELECT method, bin, count(*) AS m, avg(ok) AS acc, avg(conf) AS conf,
sum(count(*)) OVER (PARTITION BY method) AS t FROM (SELECT method, conf, ok, len(list_filter(range(1,15), lambda i: conf > i*(1.0::DOUBLE/15))) AS bin FROM (
SELECT method, list_max({p}) AS conf, ({ARG.replace("(p,", f"({p},").replace("list_max(p)", f"list_max({p})")}=y_true)::INT AS ok FROM cases WHERE level='slice')) GROUP BY method, bin) GROUP BY method"""


@query("held_out_intervals", f"""SELECT method, level, rule, round(accuracy,6) AS accuracy, round(mean,6) AS mean, round(lo,6) AS lo, round(hi,6) AS hi,
(SELECT count(*) FROM gt) AS n_units, round(ece_raw,6) AS ece_raw, round(ece_cal,6) AS ece_cal FROM (
SELECT method, level, rule, avg(a) AS mean, quantile_cont(a,0.025) AS lo, quantile_cont(a,0.975) AS hi FROM (
SELECT method, level, rule, rep, sum(w*h)/sum(w*n)::DOUBLE AS a FROM wts0 JOIN (
SELECT method, level, rule, patient_id, sum((y_true=y_pred)::INT) AS h, count(*) AS n FROM reportcases
JOIN (SELECT method, level, {_USED} FROM reportrules WHERE rule='threshold') USING (method, level, rule) GROUP BY ALL) USING (patient_id) GROUP BY ALL) GROUP BY ALL)
JOIN reportrules USING (method, level, rule) JOIN ({_ECE("p", "ece_raw")}) USING (method) JOIN ({_ECE("pc", "ece_cal")}) USING (method)""",
       ("wts0", "reportcases", "reportrules", "gt", "cases"))
def _(spark, sf):
    t = report_parts(spark, sf)
    return r6(t["intervals"].join(t["calibration"], "method"))


@query("iid_bootstrap")
def _(spark, sf):
    return rs.iid_bootstrap(me.confusion_counts(fx.preds(spark, sf), ["method"]), ["method"], K, 1000, SEED)


@query("ci_width_ratio")
def _(spark, sf):
    p = fx.preds(spark, sf)
    cluster = rs.cluster_bootstrap_accuracy(p, METHODS, B, SEED)
    iid = rs.iid_bootstrap(me.confusion_counts(p, ["method"]), ["method"], K, B, SEED)
    return rs.ci_width_ratio(cluster, iid, "method")


cte("pdelta", """SELECT b.method AS baseline, a.patient_id, sum((a.y_pred=a.y_true)::INT-(b.y_pred=a.y_true)::INT) AS d, count(*) AS n
FROM preds a JOIN preds b ON a.path=b.path WHERE a.method='proposed' AND b.method<>'proposed' GROUP BY ALL""", "preds")
cte("flip1", f"""SELECT * FROM
{sql_mixed(f"(SELECT baseline, patient_id, d, {H('patient_id')}%{P} AS g, rep FROM pdelta, range(0,{B}) r(rep))", "rep, baseline, patient_id, d, g", SEED, "rep", "5", "g", "m1")}""", "pdelta")
_SIGN = H("concat('sign|', patient_id)")
cte("flips", f"""SELECT rep, baseline, sum(CASE WHEN (m1//1024+m2//1024)%2=0 THEN d ELSE -d END) AS nul FROM
{sql_mixed(f"(SELECT *, {_SIGN}%{P} AS g2 FROM flip1)", "rep, baseline, d, m1, g2", SEED, "rep", "6", "g2", "m2")} GROUP BY ALL""", "flip1")
cte("ptest", f"""SELECT baseline, any_value(od)/any_value(o_n)::DOUBLE AS delta_accuracy, quantile_cont(ba,0.025) AS ci_low, quantile_cont(ba,0.975) AS ci_high,
(sum((abs(nul)>=abs(od)-1e-12)::INT)+1)/({B}+1)::DOUBLE AS p_raw, (SELECT count(*) FROM gt) AS n_groups FROM
(SELECT rep, baseline, sum(w*d)/sum(w*n)::DOUBLE AS ba FROM pdelta JOIN wts0 USING (patient_id) GROUP BY ALL) JOIN flips USING (rep, baseline)
JOIN (SELECT baseline, sum(d) AS od, sum(n) AS o_n FROM pdelta GROUP BY baseline) USING (baseline) GROUP BY baseline""", "pdelta", "wts0", "flips", "gt")
COMPARISONS = [m for m in METHODS if m != "proposed"]
_ORD = "list_position(" + str(COMPARISONS) + ", baseline)-1"
_PT = "round(delta_accuracy,6) AS delta_accuracy, round(ci_low,6) AS ci_low, round(ci_high,6) AS ci_high, round(p_raw,6) AS p_raw, n_groups"


@query("paired_sign_flip_test", f"SELECT baseline, CAST({_ORD} AS INT) AS declared, {_PT} FROM ptest", ("ptest",))
def _(spark, sf):
    pairs = joins.paired_vs_baselines(fx.preds(spark, sf), "proposed")
    return r6(rs.paired_sign_flip_test(pairs, COMPARISONS, B, SEED))


SQL_FAMILY = f"""SELECT baseline, CAST(declared AS INT) AS declared, {_PT}, round(max(least(1.0,(m-rk+1)*p_raw)) OVER (ORDER BY rk),6) AS p_holm FROM (
SELECT *, row_number() OVER (ORDER BY p_raw, declared) AS rk, count(*) OVER () AS m FROM (SELECT *, {_ORD} AS declared FROM ptest))"""


@query("comparison_family", SQL_FAMILY, ("ptest",))
def _(spark, sf):
    pairs = joins.paired_vs_baselines(fx.preds(spark, sf), "proposed")
    return r6(rs.comparison_family(pairs, COMPARISONS, B, SEED))
