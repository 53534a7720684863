"""Registered queries over feature tables and model heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import posterior as po
from assay.operators import features as fe, heads, joins, metrics as me, resample as rs, splits as sp
from assay.plans import fixtures as fx, modelling as mo
from assay.plans.metric_queries import K, SQL_FOLDS, SQL_MCUNIT, SQL_MEANP, SQL_VOTE, r6, sql_mean_sd
from assay.plans.registry import NA, cte, query
from assay.plans.resample_queries import B, COMPARISONS, SEED, SQL_FAMILY, SQL_PAIRED, sql_long
from assay.session import scratch_path, write_and_read
from assay.sources import readers, sinks

SPEC = "alpha+beta+gamma"


def _long(d, keys):
    return d.select(*keys, F.posexplode("features").alias("pos", "x")).select(*keys, "pos", po.nanos(F.col("x").cast("double")).alias("x"))


def sql_unnest(src: str, keys: str, expr: str = "f") -> str:
    return f"SELECT {keys}, CAST(i-1 AS INT) AS pos, {NA('x')} AS x FROM (SELECT {keys}, unnest({expr}) AS x, unnest(range(1,len({expr})+1)) AS i FROM {src})"


@query("scan_feature_table", f"SELECT backbone, role, count(*) AS n, {NA('sum(list_sum(f))')} AS checksum FROM features WHERE backbone='beta' AND role='valid' GROUP BY ALL", ("features",))
def _(spark, sf):
    out = scratch_path(spark, "features")
    fx.features(spark, sf).write.partitionBy("backbone", "role").parquet(out)
    d = readers.scan_feature_table(spark, out, "beta", "valid", fx.DIMS["beta"])
    h = fe.feature_health(d, ["backbone", "role"])
    return h.select("backbone", "role", F.col("rows").alias("n"), po.nanos(F.col("checksum")).alias("checksum"))


@query("sink_feature_table", "SELECT backbone, role, count(*) AS n, 1::BIGINT AS tables FROM features GROUP BY ALL", ("features",))
def _(spark, sf):
    f = fx.features(spark, sf)
    m = f.where("backbone = 'alpha'").select(F.col("role").alias("split"), F.col("y").cast("string").alias("label"), "path")
    from assay.operators.manifests import manifest_digest
    dig = manifest_digest(sp.manifest_row_index(m), ["split"]).withColumnRenamed("split", "role")
    out = scratch_path(spark, "feature-store")
    sinks.write_feature_table(f, out, dig, "grid8|no-resize")
    return spark.read.parquet(out).groupBy("backbone", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("tables"))


def _manifest(f):
    """Manifest rows that point into the feature table; a tenth point nowhere."""
    d = f.where("backbone = 'alpha'").select("path", "source_split", "source_row", "y", F.col("source_row").alias("pos"))
    return d.withColumn("y", F.when(F.col("source_row") % 17 == 0, F.col("y") + 1).otherwise(F.col("y")))


@query("gather_features", sql_unnest("(SELECT path, backbone, source_row AS mpos, f FROM features)", "path, backbone, mpos"), ("features",))
def _(spark, sf):
    f = fx.features(spark, sf)
    d = joins.gather_features(_manifest(f).withColumnRenamed("pos", "mpos"), f)
    return _long(d, ["path", "backbone", "mpos"])


@query("verify_labels_against_features", "SELECT backbone, count(*) AS rows, 0::BIGINT AS missing, count(*) FILTER (WHERE source_row%17=0) AS disagree FROM features GROUP BY backbone", ("features",))
def _(spark, sf):
    f = fx.features(spark, sf)
    return joins.verify_labels(_manifest(f), f)


@query("fuse_backbones", sql_unnest("(SELECT c.path, c.y, list_concat(list_concat(c.f, a.f), b.f) AS f FROM features c JOIN features a ON a.path=c.path AND a.backbone='alpha' JOIN features b ON b.path=c.path AND b.backbone='beta' WHERE c.backbone='gamma')", "path, y"), ("features",))
def _(spark, sf):
    return _long(joins.fuse_blocks(fx.features(spark, sf), "gamma+alpha+beta"), ["path", "y"])


@query("feature_block_stats", "SELECT backbone, role, count(*)//count(DISTINCT path) AS dim, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS sd FROM (SELECT backbone, role, path, unnest(f) AS x FROM features) GROUP BY ALL", ("features",))
def _(spark, sf):
    return r6(fe.feature_block_stats(fx.features(spark, sf), ["backbone", "role"]).withColumn("dim", F.col("dim").cast("bigint")))


SQL_BADF = "(SELECT backbone, role, CASE WHEN source_row%50=0 THEN list_concat(['nan'::DOUBLE], f[2:]) ELSE f END AS f FROM features)"


@query("feature_health", f"""SELECT backbone, role, count(*) AS rows, CAST(sum(len(list_filter(f, lambda x: isnan(x)))) AS BIGINT) AS nonfinite,
round(sum(list_sum(list_filter(f, lambda x: NOT isnan(x)))),6) AS checksum FROM {SQL_BADF} GROUP BY ALL""", ("features",))
def _(spark, sf):
    f = fx.features(spark, sf).withColumn("features", F.when(
        F.col("source_row") % 50 == 0, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("features", 2, 64))).otherwise(F.col("features")))
    return r6(fe.feature_health(f, ["backbone", "role"])).drop("mean_row_norm")


SQL_VIEWS = "(SELECT path, backbone, role, v, list_transform(f, lambda x, i: CASE v WHEN 0 THEN x WHEN 1 THEN x*0.9::DOUBLE+0.01::DOUBLE ELSE f[len(f)+1-i] END) AS f FROM features, (VALUES (0),(1),(2)) w(v))"


def _views(f):
    x = F.col("features").cast("array<double>")
    views = F.array(x, F.transform(x, lambda a: a * 0.9 + 0.01), F.reverse(x))
    return f.select("path", "backbone", "role", F.posexplode(views).alias("v", "features"))


@query("view_average", f"SELECT path, backbone, CAST(i-1 AS INT) AS pos, {NA('avg(x)')} AS x FROM (SELECT path, backbone, unnest(f) AS x, unnest(range(1,len(f)+1)) AS i FROM {SQL_VIEWS}) GROUP BY ALL", ("features",))
def _(spark, sf):
    return _long(fe.view_average(_views(fx.features(spark, sf)), ["path", "backbone"]), ["path", "backbone"])


@query("view_setting_classifier", """SELECT backbone, role, variant, CASE WHEN role='test' THEN 2 ELSE 1 END::INT AS tables,
CASE WHEN role='test' THEN CASE WHEN variant='mean' THEN 'view mean' ELSE 'plain' END WHEN role='train' THEN 'plain' ELSE 'undetermined' END AS setting
FROM (SELECT DISTINCT backbone, role FROM features), (VALUES ('a'),('b'),('mean')) x(variant) WHERE role='test' OR variant='a'""", ("features",))
def _(spark, sf):
    f = fx.features(spark, sf).select("path", "backbone", "role", F.col("features").cast("array<double>").alias("features"))
    a = f.withColumn("variant", F.lit("a"))
    b = f.where("role = 'test'").withColumn("features", F.transform("features", lambda x: x * 1.0005)).withColumn("variant", F.lit("b"))
    m = fe.view_average(_views(f.where("role = 'test'")), ["path", "backbone", "role"]).withColumn("variant", F.lit("mean"))
    norms = fe.feature_health(a.unionByName(b).unionByName(m), ["backbone", "role", "variant"])
    return fe.view_setting_classifier(norms)


def _fused(spark, sf):
    return mo.fused(fx.features(spark, sf), SPEC)


cte("ffu", "SELECT a.path, a.role, a.y, list_concat(list_concat(a.f,b.f),c.f) AS f FROM features a JOIN features b ON a.path=b.path AND b.backbone='beta' JOIN features c ON c.path=a.path AND c.backbone='gamma' WHERE a.backbone='alpha'", "features")


@query("standardize_train_only", f"""SELECT path, CAST(v.i-1 AS INT) AS pos, {NA("(x-m)/CASE WHEN s>1e-14 THEN s ELSE 1 END")} AS x FROM (SELECT path, unnest(f) AS x, unnest(range(1,len(f)+1)) AS i FROM ffu) v
JOIN (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(f) AS x, unnest(range(1,len(f)+1)) AS i FROM ffu WHERE role='train') GROUP BY i) t ON t.i=v.i""", ("ffu",))
def _(spark, sf):
    d = _fused(spark, sf)
    rep = fe.fit_representation(d.where("role = 'train'"), "per_dim")
    return _long(rep.apply(d), ["path"])


@query("standardize_per_block", f"""SELECT path, CAST(v.i-1 AS INT) AS pos, {NA("(x-m)/s")} AS x FROM (SELECT path, unnest(f) AS x, unnest(range(1,len(f)+1)) AS i FROM ffu) v
JOIN (SELECT backbone, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT backbone, unnest(f) AS x FROM features WHERE role='train') GROUP BY backbone) t
ON t.backbone=CASE WHEN v.i<=16 THEN 'alpha' WHEN v.i<=48 THEN 'beta' ELSE 'gamma' END""", ("ffu", "features"))
def _(spark, sf):
    d = _fused(spark, sf)
    rep = fe.fit_representation(d.where("role = 'train'"), "per_block", dims=list(fx.DIMS.values()))
    return _long(rep.apply(d), ["path"])


@query("pca_by_variance")
def _(spark, sf):
    d = _fused(spark, sf)
    rep = fe.fit_representation(d.where("role = 'train'"), "per_dim", 0.95)
    return rep.apply(d.select("path", "features")).select("path", F.size("features").alias("components"))


def _split(spark, sf, pca=0.0):
    _, z = mo.prepared(_fused(spark, sf), "per_dim", pca, None)
    return z.where("role = 'train'").drop("role"), z.where("role <> 'train'").drop("role")


def _scores(post):
    return post.select("path", "y", po.argmax_lowest(F.col("p"), fx.CLASSES).alias("y_pred"), F.array_max("p").alias("p_max"))


@query("logreg_head")
def _(spark, sf):
    return _scores(heads.fit_head("logreg", *_split(spark, sf), fx.CLASSES, c=1.0))


@query("random_forest_head")
def _(spark, sf):
    return _scores(heads.fit_head("rf", *_split(spark, sf), fx.CLASSES, trees=500, min_leaf=1))


@query("linear_svm_head")
def _(spark, sf):
    return _scores(heads.fit_head("linsvm", *_split(spark, sf), fx.CLASSES))


@query("rbf_head_approx")
def _(spark, sf):
    return _scores(heads.fit_head("rbf", *_split(spark, sf), fx.CLASSES))


#: the published settings: the most rounds of the three libraries that this head stands for
BOOSTING = {"rounds": 1200, "depth": 6}


@query("boosted_trees_head")
def _(spark, sf):
    return _scores(heads.fit_head("gbt", *_split(spark, sf), fx.CLASSES, **BOOSTING))


@query("knn_head", f"""SELECT path, y, {", ".join(f"count(*) FILTER (WHERE ny={c}) AS votes_{c}" for c in range(fx.CLASSES))} FROM (
SELECT e.path, e.y, t.y AS ny, row_number() OVER (PARTITION BY e.path ORDER BY round(list_sum(list_transform(list_zip(e.f,t.f), lambda p: (p[1]-p[2])*(p[1]-p[2]))),9), t.path) AS rk
FROM ffu e, ffu t WHERE e.role<>'train' AND t.role='train') WHERE rk<=5 GROUP BY path, y""", ("ffu",))
def _(spark, sf):
    d = _fused(spark, sf).withColumn("features", F.col("features").cast("array<double>"))
    post = heads.knn_head(d.where("role = 'train'"), d.where("role <> 'train'"), fx.CLASSES, 5)
    return post.select("path", "y", *[F.round(F.get("p", F.lit(c)) * 5).cast("bigint").alias(f"votes_{c}") for c in range(fx.CLASSES)])


BASELINES = [
    mo.Baseline("block_rbf", "alpha", "rbf", kwargs={"c": 1.0}),
    mo.Baseline("block_knn", "alpha", "knn", kwargs={"neighbours": 5}),
    mo.Baseline("wide_rbf", "beta", "rbf", kwargs={"c": 1.0}),
    mo.Baseline("fused_logreg_pca", SPEC, "logreg", pca=0.95, kwargs={"c": 1.0}),
    mo.Baseline("block_forest", "gamma", "rf", pca=0.95, kwargs={"min_leaf": 1}),
    mo.Baseline("linear_probe", SPEC, "logreg", kwargs={"c": 1.0}),
    mo.Baseline("missing_block", "alpha+delta", "logreg"),
]


@query("baseline_table")
def _(spark, sf):
    return mo.baseline_table(fx.features(spark, sf), BASELINES, fx.CLASSES, fx.DIMS)[0]


SPECS = ["alpha", "beta", "gamma", "alpha+beta", "alpha+gamma", "beta+gamma", SPEC]
LEARNERS = {"logreg": {}, "knn": {"neighbours": 5}, "rbf": {}, "gbt": BOOSTING, "linsvm": {}}


@query("grid_selection")
def _(spark, sf):
    return mo.grid_selection(fx.features(spark, sf), SPECS, LEARNERS, [0.0, 0.95], [0.1, 1.5, 10.0], fx.CLASSES, normal_idx=0)


# distances of a spec are sums over its blocks
SQL_GRID_KNN = """SELECT * FROM (WITH st AS (SELECT backbone, i, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT backbone, unnest(f) AS x, unnest(range(1,len(f)+1)) AS i FROM features WHERE role='train') GROUP BY ALL),
z AS (SELECT path, role, y, v.backbone, v.i, (x-m)/CASE WHEN s>1e-14 THEN s ELSE 1 END AS x FROM (SELECT path, role, y, backbone, unnest(f) AS x, unnest(range(1,len(f)+1)) AS i FROM features WHERE role<>'test') v JOIN st USING (backbone, i)),
d AS (SELECT a.path, a.y, b.path AS near, b.y AS ny, a.backbone, sum((a.x-b.x)*(a.x-b.x)) AS d2 FROM z a JOIN z b USING (backbone, i) WHERE a.role='valid' AND b.role='train' GROUP BY ALL),
sp AS (SELECT spec, unnest(string_split(spec,'+')) AS backbone FROM (VALUES ('alpha'),('beta'),('gamma'),('alpha+beta'),('alpha+gamma'),('beta+gamma'),('alpha+beta+gamma')) s(spec)),
r AS (SELECT spec, path, y, ny, row_number() OVER (PARTITION BY spec, path ORDER BY round(sum(d2),9), near) AS rk FROM sp JOIN d USING (backbone) GROUP BY spec, path, y, near, ny),
v AS (SELECT spec, path, y, ny, count(*) AS n FROM r WHERE rk<=5 GROUP BY ALL),
p AS (SELECT spec, path, y, first(ny ORDER BY n DESC, ny) AS y_pred FROM v GROUP BY ALL),
c AS (SELECT spec, y, count(*) AS n, count(*) FILTER (WHERE y=y_pred) AS hit FROM p GROUP BY ALL)
SELECT spec, 'knn' AS learner, round(sum(hit)/sum(n),6) AS valid_acc, round(avg(hit/n),6) AS valid_bal_acc FROM c GROUP BY spec)"""


@query("grid_selection_knn", SQL_GRID_KNN, ("features",))
def _(spark, sf):
    g = mo.grid_selection(fx.features(spark, sf), SPECS, {"knn": LEARNERS["knn"]}, [0.0], [1.5], fx.CLASSES, normal_idx=0)
    return r6(g.select("spec", "learner", "valid_acc", "valid_bal_acc"))


def _cv_folds(d):
    m = d.where("role <> 'test'").select("path", F.col("y").cast("string").alias("label"), F.col("role").alias("split"), F.col("path").alias("grp"))
    return sp.group_kfold_train_valid(m, 5, 42)


@query("cv_evaluate")
def _(spark, sf):
    d = _fused(spark, sf)
    return mo.cv_evaluate(d.select("path", "y", "features"), _cv_folds(d), fx.CLASSES, "logreg", normal_idx=0)


@query("save_pipeline_artifact", "SELECT count(*) AS scored, true AS same FROM ffu WHERE role<>'train'", ("ffu",))
def _(spark, sf):
    d = _fused(spark, sf)
    rep = fe.fit_representation(d.where("role = 'train'"), "per_dim", 0.95)
    train, rest = rep.apply(d.where("role = 'train'")), rep.apply(d.where("role <> 'train'"))
    model = heads.logreg_model(train)
    out = scratch_path(spark, "artifact")
    mo.save_artifact(spark, out, rep, model, [0.5] * fx.CLASSES, {"spec": SPEC, "normal_idx": "0"})
    rep2, model2, thr, meta = mo.load_artifact(spark, out)
    assert meta["spec"] == SPEC and len(thr) == fx.CLASSES
    a = heads.score(model, rest).select("path", F.get("p", F.lit(0)).alias("a"))
    b = heads.score(model2, rep2.apply(d.where("role <> 'train'"))).select("path", F.get("p", F.lit(0)).alias("b"))
    return a.join(b, "path").agg(F.count(F.lit(1)).alias("scored"), (F.max(F.abs(F.col("a") - F.col("b"))) < 1e-9).alias("same"))


# ---- composite reports ----

SQL_OOF = f"""SELECT 'interval' AS part, method||'|'||unit||'|'||metric AS key, round(value,6) AS value, round(lo,6) AS low, round(hi,6) AS high FROM ({sql_long("pointm", "method, unit")}) p
JOIN (SELECT method, unit, metric, quantile_cont(value,0.025) AS lo, quantile_cont(value,0.975) AS hi FROM ({sql_long("repm", "method, unit")}) GROUP BY ALL) c USING (method, unit, metric)
UNION ALL SELECT 'mcnemar', unit, p_exact_two_sided, a_correct_b_wrong::DOUBLE, a_wrong_b_correct::DOUBLE FROM ({SQL_MCUNIT})
UNION ALL SELECT 'difference', unit||'|'||metric, difference, ci95_low, ci95_high FROM ({SQL_PAIRED})
UNION ALL SELECT 'group', pooling||'|'||v.method||'|'||v.patient_id, v.y_pred::DOUBLE, g.st::DOUBLE, v.slices::DOUBLE FROM (
SELECT 'majority_vote' AS pooling, method, patient_id, y_pred, slices FROM ({SQL_VOTE}) UNION ALL SELECT 'mean_probability', method, patient_id, y_pred, slices FROM ({SQL_MEANP})) v JOIN gt g ON g.patient_id=v.patient_id
UNION ALL SELECT 'fold', method||'|'||fold, accuracy, balanced_accuracy, macro_f1 FROM ({SQL_FOLDS})
UNION ALL SELECT 'mean_sd', method, accuracy_mean, accuracy_sd, accuracy_pooled_oof FROM ({sql_mean_sd()})"""


@query("oof_analysis", SQL_OOF, ("repm", "pointm", "preds", "gt"))
def _(spark, sf):
    from assay.plans.reports import oof_analysis
    t = oof_analysis(fx.preds_table(spark, sf), "proposed", "linear_probe", K, B, SEED)

    def part(name, table, key, value, low, high):
        return t[table].select(F.lit(name).alias("part"), F.concat_ws("|", *key).alias("key"),
                               *[F.col(c).cast("double").alias(n) for c, n in ((value, "value"), (low, "low"), (high, "high"))])

    tables = [part("interval", "metric_intervals", ("method", "unit", "metric"), "estimate", "ci95_low", "ci95_high"),
              part("mcnemar", "mcnemar", ("unit",), "p_exact_two_sided", "a_correct_b_wrong", "a_wrong_b_correct"),
              part("difference", "paired_differences", ("unit", "metric"), "difference", "ci95_low", "ci95_high"),
              part("group", "group_decisions", ("pooling", "method", "patient_id"), "y_pred", "y_true", "slices"),
              part("fold", "fold_metrics", ("method", "fold"), "accuracy", "balanced_accuracy", "macro_f1"),
              part("mean_sd", "fold_mean_sd", ("method",), "accuracy_mean", "accuracy_sd", "accuracy_pooled_oof")]
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return r6(out)


@query("paired_comparison_report", f"""SELECT method, round(accuracy,6) AS accuracy, delta_accuracy, p_holm FROM (SELECT method, avg((y_true=y_pred)::INT) AS accuracy FROM preds GROUP BY method) m
LEFT JOIN ({SQL_FAMILY}) c ON c.baseline=m.method""", ("ptest", "preds"))
def _(spark, sf):
    from assay.plans.reports import paired_comparison_report
    t = paired_comparison_report(fx.preds_table(spark, sf), "proposed", COMPARISONS, K, B, SEED)
    return r6(t["results"].select("method", "accuracy").join(
        t["comparisons"].select(F.col("baseline").alias("method"), "delta_accuracy", "p_holm"), "method", "left"))


@query("readiness_report", """SELECT 'overlap' AS part, 'train|valid' AS key, 0::BIGINT AS n UNION ALL SELECT 'overlap','train|test',0 UNION ALL SELECT 'overlap','valid|test',0
UNION ALL SELECT 'rows', backbone||'|'||role, count(*) FROM features GROUP BY backbone, role
UNION ALL SELECT 'baseline', k, r FROM (VALUES ('block_rbf',1),('block_knn',1),('wide_rbf',1),('fused_logreg_pca',1),('block_forest',1),('linear_probe',1),('missing_block',0)) b(k,r)
UNION ALL SELECT 'substitution', role||'|'||backbone||'|3|1|'||CASE WHEN source_row%4=1 THEN '' ELSE 'served un-augmented' END, count(*) FROM features
WHERE role<>'train' AND backbone='gamma' AND source_row%2=1 GROUP BY ALL""", ("features",))
def _(spark, sf):
    from assay.plans.reports import readiness_report
    f = fx.features(spark, sf)
    # a bind log: three views asked for outside train, one served for the odd rows of one block
    short = (F.col("role") != "train") & (F.col("backbone") == "gamma") & (F.col("source_row") % 2 == 1)
    asked = F.when(F.col("role") == "train", 1).otherwise(3)
    binds = f.select("role", "backbone", asked.alias("requested"), F.when(short, 1).otherwise(asked).alias("effective"),
                     F.when(short & (F.col("source_row") % 4 != 1), "served un-augmented").alias("note"))
    return readiness_report(f, BASELINES, binds)
