"""Registered queries over near-duplicate vectors. The oracles compare every pair outright."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import posterior as po, vectors as ve
from assay.operators import dedup as dd, joins, selection
from assay.plans import fixtures as fx
from assay.plans.manifest_queries import sql_seed
from assay.plans.metric_queries import r6
from assay.plans.registry import H, NA, cte, query

SIDE = fx.SIDE


def sql_names(names) -> str:
    return "(" + str(list(names)) + ")"


# ---- vector expressions ----

_PERMS = [[int(i) + 1 for i in o] for o in ve.scan_orders(SIDE)]
SQL_CANON = "md5(least(" + ",".join(f"list_aggregate(list_select(q,{p}),'string_agg','')" for p in _PERMS) + "))"


@query("canonical_grid_key", f"""SELECT id, {SQL_CANON} AS key FROM (SELECT id, list_transform(v, lambda x: round_even((x-lo)/(hi-lo)*3,0)::INT::VARCHAR) AS q
FROM (SELECT id, v, list_min(v) AS lo, list_max(v) AS hi FROM vec))""", ("vec",))
def _(spark, sf):
    return fx.vectors(spark, sf).select("id", ve.canonical_grid_key(F.col("v"), SIDE).alias("key"))


@query("znorm_vector", f"""SELECT id, CAST(i-1 AS INT) AS pos, {NA("x/sd")} AS z FROM (SELECT id, unnest(c) AS x, unnest(range(1,65)) AS i, norm/8.0::DOUBLE AS sd FROM vu)""", ("vu",))
def _(spark, sf):
    d = fx.vectors(spark, sf).select("id", F.posexplode(ve.znorm(F.col("v"))).alias("pos", "z"))
    return d.select("id", "pos", po.nanos(F.col("z")).alias("z"))


@query("affine_residual", """SELECT a.id, round(list_sum(list_transform(list_zip(a.c,b.c), lambda p: abs(list_dot_product(a.c,b.c)/list_dot_product(a.c,a.c)*p[1]-p[2])))/64,6) AS residual
FROM vu a JOIN vu b ON b.id=a.id+1000000 OR b.id=a.id+2000000 OR b.id=a.id+3000000 WHERE a.id<1000000""", ("vu",))
def _(spark, sf):
    v = fx.vectors(spark, sf).select("id", "v")
    a = v.where("id < 1000000")
    b = v.where("id between 1000000 and 3999999").select((F.col("id") % 1000000).alias("id"), F.col("v").alias("w"))
    return r6(a.join(b, "id").select("id", ve.affine_residual(F.col("v"), F.col("w")).alias("residual")))


# ---- pair relations ----

cte("items", """SELECT min(id) AS item, count(*) AS n, arg_min(u,id) AS u FROM (SELECT id, u, list_transform(u, lambda x: round(x*1e6)::BIGINT) AS k FROM vu) GROUP BY k""", "vu")
cte("turned", "SELECT item, t, list_select(u, ord) AS w FROM items, scan_ord", "items", "scan_ord")
cte("ipairs", """SELECT a, b, max(s) AS corr, min(t) FILTER (WHERE s>=mx-1e-12) AS t FROM (SELECT *, max(s) OVER (PARTITION BY a,b) AS mx FROM (
SELECT x.item AS a, y.item AS b, y.t, list_dot_product(x.u, y.w) AS s FROM items x JOIN turned y ON x.item<y.item) WHERE s>0.85) GROUP BY a, b""", "items", "turned")
SQL_J7 = f"""SELECT a, b, round(corr,6) AS corr, {sql_names(ve.SCAN_NAMES)}[t+1] AS transform, CAST(x.n*y.n AS BIGINT) AS pairs
FROM ipairs JOIN items x ON x.item=a JOIN items y ON y.item=b WHERE corr>={{t}}-1e-12
UNION ALL SELECT item, item, 1.0, 'id', CAST(n*(n-1)//2 AS BIGINT) FROM items WHERE n>1"""


@query("near_duplicate_self_join", SQL_J7.format(t=0.98), ("ipairs", "items"))
def _(spark, sf):
    p = dd.near_duplicate_pairs(fx.vectors(spark, sf).select("id", "v"), SIDE, 0.98)["pairs"]
    return r6(p.select("a", "b", "corr", "transform", "pairs"))


cte("mturned", "SELECT id, t, list_select(u, ord) AS w FROM vu, scan_ord", "vu", "scan_ord")
cte("mpairs", """SELECT a, b, max(s) AS corr, min(t) FILTER (WHERE s>=mx-1e-12) AS t FROM (SELECT *, max(s) OVER (PARTITION BY a,b) AS mx FROM (
SELECT x.id AS a, y.id AS b, y.t, list_dot_product(x.u, y.w) AS s FROM vu x JOIN mturned y ON x.id<y.id) WHERE s>0.85) GROUP BY a, b""", "vu", "mturned")
SQL_MP = "(SELECT p.*, x.folder AS fa, y.folder AS fb, x.label AS la, y.label AS lb, x.role AS ra, y.role AS rb FROM mpairs p JOIN vu x ON x.id=a JOIN vu y ON y.id=b)"


@query("near_duplicate_report", f"""SELECT count(*) AS n_pairs, count(*) FILTER (WHERE corr>=0.9999) AS n_identical, count(*) FILTER (WHERE t<>0) AS n_reoriented,
count(*) FILTER (WHERE fa<>fb) AS n_cross_folder, count(*) FILTER (WHERE fa=fb) AS n_within_folder, count(*) FILTER (WHERE la<>lb) AS n_cross_class,
count(*) FILTER (WHERE ra<>rb) AS n_cross_role FROM {SQL_MP} WHERE corr>=0.98-1e-12""", ("mpairs",))
def _(spark, sf):
    return dd.near_duplicate_report(fx.vectors(spark, sf), SIDE, 0.98)


@query("threshold_sweep", f"""SELECT th::DOUBLE AS threshold, count(*) AS n_pairs, count(*) FILTER (WHERE fa<>fb) AS n_cross_folder, count(*) FILTER (WHERE ra<>rb) AS n_cross_role,
count(*) FILTER (WHERE la<>lb) AS n_cross_class, count(*) FILTER (WHERE t<>0) AS n_reoriented
FROM {SQL_MP}, (VALUES (0.999),(0.99),(0.98),(0.95),(0.90)) s(th) WHERE corr>=th::DOUBLE-1e-12 GROUP BY th""", ("mpairs",))
def _(spark, sf):
    return dd.threshold_sweep(fx.vectors(spark, sf), SIDE)


# strict relation on member level: the left vector is turned, verification order
cte("vturned", "SELECT id, t, list_select(u, ord) AS w FROM vu, verify_ord", "vu", "verify_ord")


def sql_strict(where: str) -> str:
    return f"""SELECT a, b, corr, t, list_sum(list_transform(list_zip(w,ub), lambda p: abs(corr*p[1]-p[2])))/64*nb AS residual FROM (
SELECT *, max(corr) OVER (PARTITION BY a,b) AS mx, row_number() OVER (PARTITION BY a,b ORDER BY corr<m0-1e-12, t) AS rk FROM (
SELECT *, max(corr) OVER (PARTITION BY a,b) AS m0 FROM (
SELECT x.id AS a, y.id AS b, x.t, x.w, y.u AS ub, y.norm AS nb, list_dot_product(x.w, y.u) AS corr FROM vturned x JOIN vu y ON {where}) WHERE corr>0.99)) WHERE rk=1 AND corr>=0.9995-1e-12"""


cte("spairs", "SELECT * FROM (" + sql_strict("x.id<y.id") + ") WHERE residual<=3.0", "vu", "vturned")
cte("sitems", """SELECT min(id) AS item, count(*) AS n FROM (SELECT id, list_transform(c, lambda x: round(x*1e6)::BIGINT) AS k FROM vu) GROUP BY k""", "vu")
SQL_J8 = f"""SELECT a, b, round(corr,6) AS corr, {sql_names(ve.VERIFY_NAMES)}[t+1] AS transform, round(residual,6) AS residual, CAST(x.n*y.n AS BIGINT) AS pairs
FROM spairs JOIN sitems x ON x.item=a JOIN sitems y ON y.item=b
UNION ALL SELECT item, item, 1.0, 'identity', 0.0, CAST(n*(n-1)//2 AS BIGINT) FROM sitems WHERE n>1"""


@query("strict_duplicate_pairs", SQL_J8, ("spairs", "sitems"))
def _(spark, sf):
    p = dd.strict_pairs(fx.vectors(spark, sf).select("id", "v"), SIDE)["pairs"]
    return r6(p.select("a", "b", "corr", "transform", "residual", "pairs"))


SQL_COARSE = "[" + ",".join(
    f"(c[{r * 16 + q * 2 + 1}]+c[{r * 16 + q * 2 + 2}]+c[{r * 16 + q * 2 + 9}]+c[{r * 16 + q * 2 + 10}])/4" for r in range(4) for q in range(4)) + "]"
cte("cu", f"""SELECT id, list_transform(g, lambda x: x/sqrt(list_sum(list_transform(g, lambda y: y*y)))) AS g FROM (
SELECT id, list_transform(g0, lambda x: x-list_sum(g0)/16) AS g FROM (SELECT id, {SQL_COARSE} AS g0 FROM vu))""", "vu")
SQL_SCREEN = "(SELECT p.a AS sa, p.b AS sb, max(list_dot_product(list_select(x.g, ord), y.g)) AS screen FROM spairs p JOIN cu x ON x.id=p.a JOIN cu y ON y.id=p.b, scan_ord4 GROUP BY ALL)"


@query("screen_then_verify_pairs", f"""SELECT j.* FROM ({SQL_J8}) j LEFT JOIN {SQL_SCREEN} s ON s.sa=j.a AND s.sb=j.b WHERE j.a=j.b OR s.screen>=0.995""", ("spairs", "sitems", "cu", "scan_ord4"))
def _(spark, sf):
    p = dd.strict_pairs(fx.vectors(spark, sf).select("id", "v"), SIDE, screen=True)["pairs"]
    return r6(p.select("a", "b", "corr", "transform", "residual", "pairs"))


SQL_SR = "(SELECT p.*, x.role AS ra, y.role AS rb, x.label AS la, y.label AS lb FROM spairs p JOIN vu x ON x.id=a JOIN vu y ON y.id=b)"
SQL_RP = "least(ra,rb)||'_'||greatest(ra,rb)"


cte("sitem_of", """SELECT id, min(id) OVER (PARTITION BY k) AS item FROM (SELECT id, list_transform(c, lambda x: round(x*1e6)::BIGINT) AS k FROM vu)""", "vu")
# member pairs, turned so that the first end has the smaller item, then the smaller role and class
cte("srole", f"""SELECT CASE WHEN s THEN b ELSE a END AS a, CASE WHEN s THEN a ELSE b END AS b, CASE WHEN s THEN ib ELSE ia END AS ia, CASE WHEN s THEN ia ELSE ib END AS ib,
CASE WHEN s THEN rb ELSE ra END AS ra, CASE WHEN s THEN ra ELSE rb END AS rb, CASE WHEN s THEN lb ELSE la END AS la, CASE WHEN s THEN la ELSE lb END AS lb
FROM (SELECT *, (ia,ra,la)>(ib,rb,lb) AS s FROM (SELECT p.a, p.b, p.ra, p.rb, p.la, p.lb, x.item AS ia, y.item AS ib FROM {SQL_SR} p JOIN sitem_of x ON x.id=p.a JOIN sitem_of y ON y.id=p.b))""", "spairs", "sitem_of", "vu")


@query("duplicate_pairs_roles", f"""SELECT ia AS a, ib AS b, ra AS role_a, la AS label_a, rb AS role_b, lb AS label_b, {SQL_RP.replace("ra", "r.ra").replace("rb", "r.rb")} AS role_pair, la<>lb AS cross_class,
count(*) AS pairs FROM srole r GROUP BY ALL""", ("srole",))
def _(spark, sf):
    return _roles(spark, sf).drop("first_a", "first_b")


def _roles(spark, sf):
    v = fx.vectors(spark, sf)
    p = dd.strict_pairs(v, SIDE)
    return joins.duplicate_pairs_roles(p["pairs"], p["members"].select("id", "item", "role", "label"))


@query("leakage_audit", f"""SELECT {SQL_RP} AS role_pair, count(*) FILTER (WHERE la=lb) AS same_class, count(*) FILTER (WHERE la<>lb) AS cross_class FROM {SQL_SR} GROUP BY 1""", ("spairs",))
def _(spark, sf):
    v = fx.vectors(spark, sf)
    return dd.leakage_audit(dd.strict_items(v.select("id", "v"), SIDE), v)


@query("leakage_gate", f"""SELECT f AS n_test_facing, fx AS n_test_facing_cross_class, tv AS n_train_valid, CASE WHEN f>0 THEN 'fail' ELSE 'pass' END AS gate, '' AS exempt_reason FROM (
SELECT count(*) FILTER (WHERE la=lb AND rp IN ('test_train','test_valid')) AS f, count(*) FILTER (WHERE la<>lb AND rp IN ('test_train','test_valid')) AS fx,
count(*) FILTER (WHERE la=lb AND rp='train_valid') AS tv FROM (SELECT *, {SQL_RP} AS rp FROM {SQL_SR}))""", ("spairs",))
def _(spark, sf):
    v = fx.vectors(spark, sf)
    return dd.leakage_gate(dd.leakage_audit(dd.strict_pairs(v.select("id", "v"), SIDE), v))


_RK = "CASE {} WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END"


@query("leakage_rows_touched", f"""SELECT {SQL_RP} AS role_pair, count(DISTINCT CASE WHEN {_RK.format('ra')}<{_RK.format('rb')} THEN a ELSE b END) AS n FROM {SQL_SR} WHERE ra<>rb GROUP BY 1""", ("spairs",))
def _(spark, sf):
    v = fx.vectors(spark, sf)
    return dd.rows_touched(dd.strict_pairs(v.select("id", "v"), SIDE), v)


cte("leak", f"""SELECT a AS id, b AS partner, corr, t, residual FROM (SELECT l.*, row_number() OVER (PARTITION BY l.a ORDER BY round(s.screen,9) DESC, l.b) AS best FROM (
SELECT * FROM ({sql_strict("true").replace("FROM vturned x JOIN vu y ON true", "FROM (SELECT * FROM vturned WHERE id IN (SELECT id FROM vu WHERE role<>'test')) x JOIN (SELECT * FROM vu WHERE role='test') y ON true")}) WHERE residual<=3.0) l
JOIN (SELECT p.id AS sa, q.id AS sb, max(list_dot_product(list_select(p.g, ord), q.g)) AS screen FROM (SELECT * FROM cu WHERE id IN (SELECT id FROM vu WHERE role<>'test')) p JOIN (SELECT * FROM cu WHERE id IN (SELECT id FROM vu WHERE role='test')) q ON true, scan_ord4 GROUP BY ALL) s
ON s.sa=l.a AND s.sb=l.b) WHERE best=1""", "vu", "vturned", "cu", "scan_ord4")


@query("leaked_rows_best_partner", f"SELECT id, partner, round(corr,6) AS corr, {sql_names(ve.VERIFY_NAMES)}[t+1] AS transform, round(residual,6) AS residual FROM leak", ("leak",))
def _(spark, sf):
    v = fx.vectors(spark, sf)
    return r6(dd.leaked_rows_best_partner(v.where("role <> 'test'").select("id", "v"), v.where("role = 'test'").select("id", "v"), SIDE))


@query("examples_per_category", """SELECT role_pair, ra AS role_a, rb AS role_b, ia AS a, ib AS b, first_a, first_b FROM (SELECT *, row_number() OVER (PARTITION BY role_pair ORDER BY ia, ib, ra, rb, la, lb) AS rk FROM (
SELECT ia, ib, ra, rb, la, lb, least(ra,rb)||'_'||greatest(ra,rb) AS role_pair, min(a) AS first_a, min(b) AS first_b FROM (
SELECT ia, ib, ra, rb, la, lb, CASE WHEN (ia,ra,la)=(ib,rb,lb) THEN least(a,b) ELSE a END AS a, CASE WHEN (ia,ra,la)=(ib,rb,lb) THEN greatest(a,b) ELSE b END AS b FROM srole WHERE ra<>rb)
GROUP BY ALL)) WHERE rk<=5""", ("srole",))
def _(spark, sf):
    cross = _roles(spark, sf).where("role_a <> role_b")
    return selection.examples_per_category(cross, "role_pair", ["a", "b", "role_a", "role_b", "label_a", "label_b"], 5).select(
        "role_pair", "role_a", "role_b", "a", "b", "first_a", "first_b")


@query("topk_candidates", """SELECT a, b, round(corr,6) AS corr, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(corr,9) DESC, b) AS rk FROM (
SELECT a, b, corr FROM ipairs WHERE corr>=0.9-1e-12 UNION ALL SELECT b, a, corr FROM ipairs WHERE corr>=0.9-1e-12)) WHERE rk<=2""", ("ipairs",))
def _(spark, sf):
    p = dd.near_duplicate_pairs(fx.vectors(spark, sf).select("id", "v"), SIDE, 0.90)["pairs"].where("a <> b").select("a", "b", F.round("corr", 9).alias("corr"))
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    return r6(selection.topk_candidates(both, "a", "corr", "b", 2))


cte("pool", "SELECT id, label FROM vu WHERE role<>'test'", "vu")
cte("sym", "SELECT a, b FROM spairs WHERE a IN (SELECT id FROM pool) AND b IN (SELECT id FROM pool) UNION SELECT b, a FROM spairs WHERE a IN (SELECT id FROM pool) AND b IN (SELECT id FROM pool)", "spairs", "pool")
cte("reach", "/* RECURSIVE_STEP */ SELECT id, id AS r FROM pool UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a=reach.r", "sym", "pool")


@query("duplicate_components", "SELECT id, min(r) AS component FROM reach GROUP BY id", ("reach",))
def _(spark, sf):
    v = fx.vectors(spark, sf)
    return dd.duplicate_components(dd.strict_items(v.select("id", "v"), SIDE), v.where("role <> 'test'"))


@query("content_group_key", f"""SELECT 'strict' AS mode, count(DISTINCT g) AS groups, count(*) AS n FROM (SELECT id, min(r) AS g FROM reach GROUP BY id)
UNION ALL SELECT 'none', count(*), count(*) FROM pool
UNION ALL SELECT 'md5', count(DISTINCT v), count(*) FROM vec WHERE role<>'test'
UNION ALL SELECT 'canonical', count(DISTINCT {SQL_CANON}), count(*) FROM (SELECT id, list_transform(v, lambda x: round_even((x-list_min(v))/(list_max(v)-list_min(v))*3,0)::INT::VARCHAR) AS q FROM vec WHERE role<>'test')""", ("reach", "vec"))
def _(spark, sf):
    v = fx.vectors(spark, sf)
    pool = v.where("role <> 'test'").select("id", "v")
    rel = dd.strict_items(v.select("id", "v"), SIDE)
    out = None
    for mode in ("none", "md5", "canonical", "strict"):
        g = dd.content_group_key(pool, mode, SIDE, rel if mode == "strict" else None)
        row = g.agg(F.lit(mode).alias("mode"), F.count_distinct("grp").alias("groups"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def _corpora(spark, sf):
    v = fx.vectors(spark, sf)
    return v.where("id < 1000000"), v.where("id >= 1000000")


cte("xmatch", f"""SELECT l.a AS id, min_by(l.b, (-round(s.screen,9), l.b)) AS partner FROM (SELECT * FROM ({sql_strict("true").replace("FROM vturned x JOIN vu y ON true", "FROM (SELECT * FROM vturned WHERE id<1000000) x JOIN (SELECT * FROM vu WHERE id>=1000000) y ON true")}) WHERE residual<=3.0) l
JOIN (SELECT p.id AS sa, q.id AS sb, max(list_dot_product(list_select(p.g, ord), q.g)) AS screen FROM (SELECT * FROM cu WHERE id<1000000) p JOIN (SELECT * FROM cu WHERE id>=1000000) q ON true, scan_ord4 GROUP BY ALL) s ON s.sa=l.a AND s.sb=l.b GROUP BY l.a""", "vu", "vturned", "cu", "scan_ord4")


@query("cross_corpus_match", "SELECT v.id, x.partner, p.label AS partner_label, p.role AS partner_role FROM vu v LEFT JOIN xmatch x ON x.id=v.id LEFT JOIN vu p ON p.id=x.partner WHERE v.id<1000000", ("xmatch", "vu"))
def _(spark, sf):
    a, b = _corpora(spark, sf)
    return dd.cross_corpus_match(a, b, SIDE).select("id", "partner", "partner_label", "partner_role")


@query("cross_corpus_exposure", """SELECT coalesce(v.folder,'ALL') AS folder, count(*) AS n, count(x.partner) AS matched, count(*) FILTER (WHERE p.role='train') AS into_train, count(*) FILTER (WHERE p.role='test') AS into_test,
count(*) FILTER (WHERE p.label<>v.label) AS contradictions, count(DISTINCT x.partner) AS distinct_targets, count(*) FILTER (WHERE v.role='test' AND p.role IN ('train','valid')) AS test_in_other_dev,
count(x.partner)-count(DISTINCT x.partner) AS collisions, round(count(x.partner)/count(*)::DOUBLE,6) AS coverage
FROM vu v LEFT JOIN xmatch x ON x.id=v.id LEFT JOIN vu p ON p.id=x.partner WHERE v.id<1000000 GROUP BY ROLLUP (v.folder)""", ("xmatch", "vu"))
def _(spark, sf):
    a, b = _corpora(spark, sf)
    return r6(dd.cross_corpus_exposure(dd.cross_corpus_match(a, b, SIDE)))


@query("cohort_independence", "SELECT count(DISTINCT doc_id%2)>1 AS spans_both, count(DISTINCT doc_id%2)<=1 AS independent FROM documents")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "pw_family").otherwise("nick").alias("cohort"))
    rules = spark.createDataFrame([("pw", "corpus_a"), ("nick", "corpus_b"), ("bal", "corpus_b")], "family string, side string")
    return dd.independence_verdict(d, rules)


# ---- dataset builders ----

def _train_and_test(spark, sf):
    """The manifest with its own valid rows as training rows: valid is carved anew."""
    return fx.manifest_table(spark, sf).withColumn("split", F.when(F.col("split") == "test", "test").otherwise("train"))


cte("cgp", f"""SELECT label, grp, n, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(42, 'carve', 'grp')}, grp) AS rk FROM (
SELECT label, grp, count(*) AS n FROM manifest WHERE split<>'test' GROUP BY ALL)""", "manifest")
cte("walkp", """/* RECURSIVE_STEP */ SELECT label, 0::BIGINT AS rk, CAST(round_even(sum(n)*0.15::DOUBLE,0) AS BIGINT) AS room, NULL::VARCHAR AS grp, false AS take, 0::BIGINT AS n FROM cgp GROUP BY label
UNION ALL SELECT w.label, g.rk, CASE WHEN g.n<=w.room THEN w.room-g.n ELSE w.room END, g.grp, g.n<=w.room, g.n FROM walkp w JOIN cgp g ON g.label=w.label AND g.rk=w.rk+1""", "cgp")


@query("published_split_dataset", """SELECT m.path, m.label, CASE WHEN m.split='test' THEN 'test' WHEN w.grp IS NOT NULL THEN 'valid' ELSE 'train' END AS role
FROM manifest m LEFT JOIN (SELECT * FROM walkp WHERE take) w ON w.grp=m.grp AND w.label=m.label""", ("walkp", "manifest"))
def _(spark, sf):
    from assay.plans.datasets import published_split_dataset
    m = _train_and_test(spark, sf)
    counts = m.groupBy("split", "label").agg(F.count(F.lit(1)).alias("published")).withColumn("release", F.lit("v2"))
    return published_split_dataset(m, counts, 0.15, 42)["manifest"].select("path", "label", "role")


cte("surv", "SELECT id, label::VARCHAR AS label FROM vu WHERE role<>'test' AND id NOT IN (SELECT id FROM leak)", "vu", "leak")
cte("dsym", "SELECT a, b FROM spairs WHERE a IN (SELECT id FROM surv) AND b IN (SELECT id FROM surv) UNION SELECT b, a FROM spairs WHERE a IN (SELECT id FROM surv) AND b IN (SELECT id FROM surv)", "spairs", "surv")
cte("dreach", "/* RECURSIVE_STEP */ SELECT id, id AS r FROM surv UNION SELECT dreach.id, dsym.b FROM dreach JOIN dsym ON dsym.a=dreach.r", "dsym", "surv")
cte("dgrp", "SELECT s.id, s.label, min(r)::VARCHAR AS grp FROM dreach d JOIN surv s ON s.id=d.id GROUP BY s.id, s.label", "dreach", "surv")
cte("dcg", f"""SELECT label, grp, n, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(42, 'carve', 'grp')}, grp) AS rk FROM (
SELECT label, grp, count(*) AS n FROM dgrp GROUP BY ALL)""", "dgrp")
cte("dwalk", """/* RECURSIVE_STEP */ SELECT label, 0::BIGINT AS rk, CAST(round_even(sum(n)*0.15::DOUBLE,0) AS BIGINT) AS room, NULL::VARCHAR AS grp, false AS take, 0::BIGINT AS n FROM dcg GROUP BY label
UNION ALL SELECT w.label, g.rk, CASE WHEN g.n<=w.room THEN w.room-g.n ELSE w.room END, g.grp, g.n<=w.room, g.n FROM dwalk w JOIN dcg g ON g.label=w.label AND g.rk=w.rk+1""", "dcg")


@query("deduplicated_dataset", """SELECT v.id, v.label::VARCHAR AS label, CASE WHEN v.role='test' THEN 'test' WHEN l.id IS NOT NULL THEN 'removed' WHEN w.grp IS NOT NULL THEN 'valid' ELSE 'train' END AS role
FROM vu v LEFT JOIN leak l ON l.id=v.id AND v.role<>'test' LEFT JOIN dgrp g ON g.id=v.id LEFT JOIN (SELECT * FROM dwalk WHERE take) w ON w.grp=g.grp AND w.label=g.label""", ("dwalk", "dgrp", "leak", "vu"))
def _(spark, sf):
    from assay.plans.datasets import deduplicated_dataset
    v = fx.vectors(spark, sf).withColumn("label", F.col("label").cast("string")).withColumn(
        "role", F.when(F.col("role") == "test", "test").otherwise("train"))
    return deduplicated_dataset(v, SIDE, 0.15, 42).select("id", "label", "role")


cte("bwalk", """/* RECURSIVE_STEP */ SELECT label, 0::BIGINT AS rk, 10::BIGINT AS room, NULL::VARCHAR AS grp, false AS take, 0::BIGINT AS n FROM cgp GROUP BY label
UNION ALL SELECT w.label, g.rk, CASE WHEN g.n<=w.room THEN w.room-g.n ELSE w.room END, g.grp, g.n<=w.room, g.n FROM bwalk w JOIN cgp g ON g.label=w.label AND g.rk=w.rk+1""", "cgp")
cte("bpool", "SELECT m.path, m.label, w.grp IS NOT NULL AS v FROM manifest m LEFT JOIN (SELECT * FROM bwalk WHERE take) w ON w.grp=m.grp AND w.label=m.label WHERE m.split<>'test'", "bwalk", "manifest")
cte("bbal", f"""SELECT path, label FROM (SELECT path, label, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(43, 'subsample', 'path')}, path) AS rk FROM bpool WHERE NOT v)
WHERE rk<=(SELECT min(n) FROM (SELECT count(*) AS n FROM bpool WHERE NOT v GROUP BY label))""", "bpool")
cte("bsub", f"""SELECT path, label FROM (SELECT path, label, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(44, 'subsample', 'path')}, path) AS rk, count(*) OVER (PARTITION BY label) AS n FROM bbal)
WHERE rk<=floor(n*(1+{H('label')}%4)/4.0::DOUBLE)""", "bbal")


@query("balanced_and_subsampled_pair", """SELECT 'balanced' AS dataset, path, label, 'train' AS role FROM bbal UNION ALL SELECT 'subsampled', path, label, 'train' FROM bsub
UNION ALL SELECT d, path, label, 'valid' FROM bpool, (VALUES ('balanced'),('subsampled')) x(d) WHERE v
UNION ALL SELECT d, path, label, 'test' FROM manifest, (VALUES ('balanced'),('subsampled')) x(d) WHERE split='test'""", ("bsub", "bbal", "bpool", "manifest"))
def _(spark, sf):
    from assay.functions.hashing import h32
    from assay.plans.datasets import balanced_and_subsampled_pair
    share = (1 + h32(F.col("label")) % 4) / F.lit(4.0)
    return balanced_and_subsampled_pair(_train_and_test(spark, sf), 10, share, 42)
