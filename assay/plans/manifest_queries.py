"""Registered queries over manifests, splits, ledgers and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.functions import hashing as ha, posterior as po, text as tx
from assay.operators import audits, joins, manifests as ma, selection, splits as sp
from assay.operators.metrics import group_majority_label
from assay.plans import fixtures as fx
from assay.plans.metric_queries import r6
from assay.plans.registry import H, NA, cte, query
from assay.session import scratch_path
from assay.sources import readers, sinks

ALIASES = ["training", "Val ", " TEST", "validation", "", "train", "testing"]
SQL_ALIAS = "(" + str(ALIASES) + ")[doc_id%7+1]"


def _alias(doc_id="doc_id"):
    return F.element_at(F.array(*[F.lit(a) for a in ALIASES]), (F.col(doc_id) % 7 + 1).cast("int"))


@query("normalize_split_alias", f"""SELECT doc_id, CASE lower(trim({SQL_ALIAS})) WHEN '' THEN 'train' WHEN 'train' THEN 'train' WHEN 'training' THEN 'train'
WHEN 'val' THEN 'valid' WHEN 'valid' THEN 'valid' WHEN 'validation' THEN 'valid' ELSE 'test' END AS split FROM documents""")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.normalize_split(_alias()).alias("split"))


SQL_STEM = r"regexp_replace(regexp_extract(replace(raw,'\','/'),'[^/]*$'),'(.)\.[^.]*$','\1')"


@query("group_id_from_path", f"SELECT o_orderkey, split_part({SQL_STEM},'__',1) AS gid FROM ids", ("ids",))
def _(spark, sf):
    return fx.ids(spark, sf).select("o_orderkey", tx.group_id_from_path(F.col("raw")).alias("gid"))


SQL_FAMILY = rf"regexp_replace(split_part({SQL_STEM},'__',1),'^(MR\d+)[A-Z]$','\1')"


@query("group_family", f"SELECT o_orderkey, {SQL_FAMILY} AS family FROM ids", ("ids",))
def _(spark, sf):
    return fx.ids(spark, sf).select("o_orderkey", tx.group_family(tx.group_id_from_path(F.col("raw"))).alias("family"))


@query("group_key_by_unit", f"""SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN {SQL_STEM} WHEN 1 THEN split_part({SQL_STEM},'__',1) ELSE {SQL_FAMILY} END AS key FROM ids""", ("ids",))
def _(spark, sf):
    unit = F.element_at(F.array(F.lit("image"), F.lit("identifier"), F.lit("family")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return fx.ids(spark, sf).select("o_orderkey", tx.group_key(F.col("raw"), unit).alias("key"))


@query("safe_name", r"""SELECT c_custkey, regexp_replace(replace(c_name||'+'||c_mktsegment||' (a/b)','+','PLUS'),'[^a-zA-Z0-9_.-]+','_','g') AS safe,
trim(replace(replace(lower(c_mktsegment||' No-Sign'),'-','_'),' ','_')) AS normalised FROM customer""")
def _(spark, sf):
    c = fx.table(spark, sf, "customer")
    raw = F.concat("c_name", F.lit("+"), "c_mktsegment", F.lit(" (a/b)"))
    return c.select("c_custkey", tx.safe_name(raw).alias("safe"),
                    tx.normalize_class_name(F.concat("c_mktsegment", F.lit(" No-Sign"))).alias("normalised"))


@query("label_encode_sorted", """SELECT path, label, CAST(dense_rank() OVER (ORDER BY label)-1 AS INT) AS y FROM manifest""", ("manifest",))
def _(spark, sf):
    return ma.label_encode(fx.manifest_table(spark, sf)).select("path", "label", "y")


def _classes(spark, sf) -> DataFrame:
    c = fx.table(spark, sf, "customer").select(
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Healthy").when(F.col("c_mktsegment") == "MACHINERY", "No-Tumor")
        .otherwise(F.col("c_mktsegment")).alias("label"))
    return ma.class_table(c)


SQL_CLASSES = """(SELECT label, row_number() OVER (ORDER BY label)-1 AS idx FROM (SELECT DISTINCT CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Healthy' WHEN 'MACHINERY' THEN 'No-Tumor' ELSE c_mktsegment END AS label FROM customer))"""
SQL_CN = "replace(replace(lower(label),'-','_'),' ','_')"


@query("find_normal_class", f"""SELECT 'any' AS variant, CAST(min(idx) AS INT) AS normal_idx FROM {SQL_CLASSES} WHERE {SQL_CN} IN {tx.NORMAL_ALIASES_ANY}
UNION ALL SELECT 'ranked', CAST(arg_min(idx, list_position({list(tx.NORMAL_ALIASES_RANKED)}, {SQL_CN})) AS INT) FROM {SQL_CLASSES} WHERE {SQL_CN} IN {tx.NORMAL_ALIASES_RANKED}
UNION ALL SELECT 'named', CAST(min(idx) AS INT) FROM {SQL_CLASSES} WHERE {SQL_CN}='building'""")
def _(spark, sf):
    c = _classes(spark, sf)
    parts = [("any", ma.find_normal_class(c, ranked=False)), ("ranked", ma.find_normal_class(c)),
             ("named", ma.find_normal_class(c, "Building"))]
    out = [d.select(F.lit(v).alias("variant"), "normal_idx") for v, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("role_filter", "SELECT path, label FROM manifest WHERE split='test'", ("manifest",))
def _(spark, sf):
    return fx.manifest(spark, sf).where("split = 'test'").select("path", "label")


@query("relative_posix_path", r"SELECT o_orderkey, regexp_replace(replace(raw,'\','/'),'^corpus/','') AS rel FROM ids", ("ids",))
def _(spark, sf):
    return fx.ids(spark, sf).select("o_orderkey", tx.relative_posix(F.col("raw"), "corpus").alias("rel"))


@query("null_nonfinite", f"""SELECT event_id, CASE WHEN event_id%10<3 THEN NULL ELSE {NA('value')} END AS clean FROM events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "value")
    dirty = (F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(float("inf")))
             .when(F.col("event_id") % 10 == 2, F.lit(float("-inf"))).otherwise(F.col("value")))
    arr = tx.null_nonfinite_array(F.array(dirty))
    return e.select("event_id", po.nanos(F.coalesce(tx.null_nonfinite(dirty), F.get(arr, F.lit(0)))).alias("clean"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", ha.content_sha256(F.col("text")).alias("sha256"), ha.content_md5(F.col("text")).alias("md5"))


def sql_digest(src: str, keys: str, pos: str, item: str) -> str:
    return f"""SELECT {keys}, md5(string_agg(h,'' ORDER BY b2)) AS digest FROM (SELECT {keys}, b2, md5(string_agg(h,'' ORDER BY b1)) AS h FROM (
SELECT {keys}, b2, b1, md5(string_agg(h,'' ORDER BY pos)) AS h FROM (SELECT {keys}, {pos} AS pos, md5({item}) AS h, {pos}//4096 AS b1, {pos}//16777216 AS b2 FROM {src})
GROUP BY {keys}, b2, b1) GROUP BY {keys}, b2) GROUP BY {keys}"""


cte("indexed", "SELECT *, row_number() OVER (PARTITION BY split ORDER BY label, path)-1 AS pos FROM manifest", "manifest")


@query("manifest_digest", sql_digest("indexed", "split", "pos", "path||chr(1)||label"), ("indexed",))
def _(spark, sf):
    return ma.manifest_digest(sp.manifest_row_index(fx.manifest_table(spark, sf)), ["split"])


@query("rule_id_digest", """SELECT candidate, sha256('{"candidate":'||candidate||',"learner":"'||learner||'","spec":"'||spec||'"}') AS digest,
'candidate='||candidate||'|learner='||learner||'|spec='||spec AS rule FROM grid""", ("grid",))
def _(spark, sf):
    cols = {"spec": F.col("spec"), "learner": F.col("learner"), "candidate": F.col("candidate")}
    return fx.grid(spark, sf).select("candidate", ha.settings_digest(cols).alias("digest"), ha.rule_string(cols).alias("rule"))


COHORTS = ["pw_identifier", "PW_family", "nick", "nick_dedup", "bal", "other"]
SQL_COHORT = "(" + str(COHORTS) + ")[doc_id%6+1]"
SQL_FAM = f"CASE WHEN lower({SQL_COHORT}) LIKE 'pw%' THEN 'pw' WHEN lower({SQL_COHORT}) LIKE 'nick%' THEN 'nick' ELSE lower({SQL_COHORT}) END"


def _cohort(d):
    return d.withColumn("cohort", F.element_at(F.array(*[F.lit(c) for c in COHORTS]), (F.col("doc_id") % 6 + 1).cast("int")))


@query("cohort_family_key", f"""SELECT doc_id, {SQL_FAM} AS family, CASE {SQL_FAM} WHEN 'bal' THEN 'bal' WHEN 'nick' THEN 'bal' ELSE {SQL_FAM} END AS features FROM documents""")
def _(spark, sf):
    d = _cohort(fx.table(spark, sf, "documents").select("doc_id"))
    return d.select("doc_id", tx.cohort_family(F.col("cohort")).alias("family"), tx.feature_family(F.col("cohort")).alias("features"))


@query("reportability_stamp", f"""SELECT doc_id, {SQL_FAM}<>'bal' AS reportable, CASE {SQL_FAM} WHEN 'bal' THEN 'split is not the published one' ELSE '' END AS reason,
CASE {SQL_FAM} WHEN 'pw' THEN '571/781' WHEN 'nick' THEN '607/1600' WHEN 'bal' THEN '607/1600' ELSE '' END AS shared FROM documents""")
def _(spark, sf):
    rules = spark.createDataFrame(
        [("pw", True, "", 571, 781), ("nick", True, "", 607, 1600), ("bal", False, "split is not the published one", 607, 1600)],
        "family string, reportable boolean, reason string, shared_n int, shared_of int")
    d = _cohort(fx.table(spark, sf, "documents").select("doc_id"))
    return audits.stamp_reportability(d, "cohort", rules).select("doc_id", "reportable", "reason", "shared")


@query("split_summary", """SELECT coalesce(split,'ALL') AS split, coalesce(label,'ALL') AS label, count(*) AS rows,
CASE WHEN label IS NULL AND split IS NOT NULL THEN count(DISTINCT grp) END AS groups FROM manifest GROUP BY ROLLUP (split, label)""", ("manifest",))
def _(spark, sf):
    return ma.split_summary(fx.manifest_table(spark, sf))


def sql_dupgroups(src: str, key: str) -> str:
    return f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n)-count(*) AS BIGINT) AS n_redundant,
count(*) FILTER (WHERE n>1) AS n_groups_with_copies, max(n) AS largest_group, count(*) FILTER (WHERE s>1) AS n_cross_split_groups,
count(*) FILTER (WHERE l>1) AS n_cross_class_groups FROM (SELECT {key}, count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT label) AS l FROM {src} GROUP BY {key})"""


@query("duplicate_groups_report", sql_dupgroups("manifest", "sha256"), ("manifest",))
def _(spark, sf):
    return ma.duplicate_groups_report(fx.manifest_table(spark, sf), "sha256")


@query("duplicate_groups_examples", """SELECT sha256, count(*) AS copies, min(path) AS first_path FROM manifest GROUP BY sha256
HAVING count(DISTINCT split)>1 ORDER BY sha256 LIMIT 200""", ("manifest",))
def _(spark, sf):
    return ma.duplicate_groups_examples(fx.manifest_table(spark, sf), "sha256", 200)


SQL_EXPECT = f"""(SELECT rel AS release, split, label, CASE rel WHEN 'v2' THEN n ELSE n+{H("label")}%3 END AS published FROM
(SELECT split, label, count(*) AS n FROM manifest GROUP BY ALL), (VALUES ('v1'),('v2')) r(rel))"""


@query("corpus_fingerprint_check", f"""SELECT *, min(matches) OVER (PARTITION BY release) AS release_match FROM (
SELECT e.release, e.split, e.label, o.n AS observed, e.published, o.n=e.published AS matches FROM {SQL_EXPECT} e
JOIN (SELECT split, label, count(*) AS n FROM manifest GROUP BY ALL) o ON e.split=o.split AND e.label=o.label)""", ("manifest",))
def _(spark, sf):
    m = fx.manifest_table(spark, sf)
    n = m.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    expected = n.withColumn("release", F.explode(F.array(F.lit("v1"), F.lit("v2")))).select(
        "release", "split", "label",
        F.when(F.col("release") == "v2", F.col("n")).otherwise(F.col("n") + ha.h32(F.col("label")) % 3).alias("published"))
    return ma.corpus_fingerprint_check(m, expected)


SQL_VM = """SELECT 'missing_label' AS rule, count(*) FILTER (WHERE label IS NULL OR trim(label)='') AS violations FROM {t}
UNION ALL SELECT 'missing_group', count(*) FILTER (WHERE grp IS NULL OR trim(grp)='') FROM {t}
UNION ALL SELECT 'partial_groups', (count(*) FILTER (WHERE grp IS NULL OR trim(grp)='')>0 AND count(*) FILTER (WHERE trim(grp)<>'')>0)::BIGINT FROM {t}
UNION ALL SELECT 'unknown_split', count(*) FILTER (WHERE split IS NULL OR split NOT IN ('train','valid','test')) FROM {t}
UNION ALL SELECT 'repeated_path', count(*) FROM (SELECT 1 FROM {t} GROUP BY path HAVING count(*)>1)
UNION ALL SELECT 'group_crosses_splits', count(*) FROM (SELECT 1 FROM {t} GROUP BY grp HAVING count(DISTINCT split)>1)
UNION ALL SELECT 'group_crosses_labels', count(*) FROM (SELECT 1 FROM {t} GROUP BY grp HAVING count(DISTINCT label)>1)
UNION ALL SELECT 'class_missing_in_split', count(DISTINCT label)*3-count(DISTINCT split||'|'||label) FROM {t} WHERE split IN ('train','valid','test')"""


@query("validate_manifest", SQL_VM.format(t="manifest"), ("manifest",))
def _(spark, sf):
    return audits.validate_manifest(fx.manifest_table(spark, sf))


SQL_VMD = """(SELECT path, CASE WHEN h%37=0 THEN ' ' ELSE label END AS label, CASE WHEN h%41=0 THEN 'holdout' ELSE split END AS split,
CASE WHEN h%43=0 THEN NULL ELSE grp END AS grp FROM (SELECT *, """ + H("path") + """ AS h FROM manifest))"""


@query("validate_manifest_defects", SQL_VM.format(t=SQL_VMD), ("manifest",))
def _(spark, sf):
    m = fx.manifest_table(spark, sf).withColumn("h", ha.h32(F.col("path")))
    m = m.select("path", F.when(F.col("h") % 37 == 0, " ").otherwise(F.col("label")).alias("label"),
                 F.when(F.col("h") % 41 == 0, "holdout").otherwise(F.col("split")).alias("split"),
                 F.when(F.col("h") % 43 != 0, F.col("grp")).alias("grp"))
    return audits.validate_manifest(m)


def sql_seed(seed: int, purpose: str, key: str) -> str:
    return f"md5('{seed}|{purpose}|'||{key})"


cte("groups", "SELECT DISTINCT grp, label FROM manifest", "manifest")
cte("folds", f"""SELECT grp, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {sql_seed(42, 'fold', 'grp')}, grp)-1)%5 AS INT) AS fold FROM groups""", "groups")
cte("holdout", f"""SELECT fold, grp, label, 'test' AS role FROM folds UNION ALL SELECT fold, grp, label,
CASE WHEN rk<=greatest(1,least(n-1,round_even(n*0.2::DOUBLE,0))) THEN 'valid' ELSE 'train' END FROM (
SELECT k AS fold, grp, label, row_number() OVER (PARTITION BY k, label ORDER BY {sql_seed(42, 'valid', "k||'|'||grp")}, grp) AS rk,
count(*) OVER (PARTITION BY k, label) AS n FROM folds, range(0,5) r(k) WHERE k<>fold)""", "folds")


def _folds(spark, sf):
    return sp.grouped_stratified_folds(sp.group_labels(fx.manifest_table(spark, sf), strict=False), 5, 42)  # a text can have two languages


@query("grouped_stratified_kfold", "SELECT grp, label, fold FROM folds", ("folds",))
def _(spark, sf):
    return _folds(spark, sf)


@query("validation_holdout_per_fold", "SELECT CAST(fold AS INT) AS fold, grp, label, role FROM holdout", ("holdout",))
def _(spark, sf):
    return sp.validation_holdout(_folds(spark, sf), 5, 0.2, 42)


SQL_VF = """SELECT 'group_in_two_test_folds' AS rule, count(*) FILTER (WHERE t>1) AS violations FROM (SELECT grp, count(DISTINCT CASE WHEN role='test' THEN fold END) AS t FROM {t} GROUP BY grp)
UNION ALL SELECT 'group_never_tested', count(*) FILTER (WHERE t=0) FROM (SELECT grp, count(DISTINCT CASE WHEN role='test' THEN fold END) AS t FROM {t} GROUP BY grp)
UNION ALL SELECT 'row_not_in_every_fold', count(*) FROM (SELECT path FROM {t} GROUP BY path HAVING count(DISTINCT fold)<>(SELECT count(DISTINCT fold) FROM {t}))
UNION ALL SELECT 'row_repeated_in_fold', count(*) FROM (SELECT path FROM {t} GROUP BY path HAVING count(*)>count(DISTINCT fold))
UNION ALL SELECT 'group_crosses_roles', count(*) FROM (SELECT 1 FROM {t} GROUP BY fold, grp HAVING count(DISTINCT role)>1)"""
SQL_FROWS = f"""(SELECT fold, m.grp, path, CASE WHEN {H("path||'|'||fold")}%211=0 THEN 'train' ELSE role END AS role FROM manifest m JOIN holdout h ON m.grp=h.grp WHERE {H("path||'|'||fold")}%223<>0)"""


@query("validate_outer_folds", SQL_VF.format(t=SQL_FROWS), ("manifest", "holdout"))
def _(spark, sf):
    m = fx.manifest_table(spark, sf)
    folds = sp.grouped_stratified_folds(sp.group_labels(m, strict=False), 5, 42)
    rows = m.select("path", "grp").join(sp.validation_holdout(folds, 5, 0.2, 42), "grp")
    h = ha.h32(F.concat_ws("|", "path", "fold"))
    rows = rows.withColumn("role", F.when(h % 211 == 0, "train").otherwise(F.col("role"))).where(h % 223 != 0)
    return audits.validate_outer_folds(rows)


def sql_carve(src: str, target: str, frac: str, seed: int) -> str:
    return f"""SELECT path, label, CASE WHEN split='train' AND grp IN (SELECT grp FROM (
SELECT grp, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(seed, target, 'grp')}, grp) AS rk, count(*) OVER (PARTITION BY label) AS n
FROM (SELECT DISTINCT label, grp FROM {src} WHERE split='train')) WHERE rk<=greatest(1,least(n-1,round_even(n*{frac},0)))) THEN '{target}' ELSE split END AS split, grp, sha256 FROM {src}"""


cte("carved_test", sql_carve("manifest_flat", "test", "0.2::DOUBLE", 42), "manifest_flat")
cte("carved", sql_carve("carved_test", "valid", "(0.2::DOUBLE/(1-0.2::DOUBLE))", 43), "carved_test")


@query("carve_split", "SELECT path, label, split, grp FROM carved", ("carved",))
def _(spark, sf):
    out, made = sp.carve_missing_splits(fx.manifest_flat(spark, sf), 0.2, 0.2, 42)
    assert made == ["test", "valid"]
    return out.select("path", "label", "split", "grp")


@query("prepare_manifest", "SELECT path, label, split, grp, sha256 FROM carved", ("carved",))
def _(spark, sf):
    from assay.plans.datasets import prepare_manifest
    d = fx.table(spark, sf, "documents")
    raw = fx.manifest_flat(spark, sf).drop("sha256")
    content = d.select(F.expr("concat(source, '/', lang, '_', doc_id, '__', n_chars, '.txt')").alias("path"), F.col("text").alias("content"))
    return prepare_manifest(raw, content, strict=False)["manifest"]


@query("nested_subsample", f"""SELECT path, label FROM (SELECT path, label, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(43, 'subsample', 'path')}, path) AS rk,
count(*) OVER (PARTITION BY label) AS n FROM manifest WHERE split='train') WHERE rk<=n//3""", ("manifest",))
def _(spark, sf):
    train = fx.manifest_table(spark, sf).where("split = 'train'").select("path", "label")
    targets = train.groupBy("label").agg(F.floor(F.count(F.lit(1)) / 3).alias("target"))
    return sp.nested_subsample(train, targets, 43)


SQL_STRADDLE = """SELECT grp, arg_max(split, (n, CASE split WHEN 'test' THEN 2 WHEN 'valid' THEN 1 ELSE 0 END)) AS role, count(*)>1 AS straddled
FROM (SELECT grp, split, count(*) AS n FROM manifest GROUP BY ALL) GROUP BY grp"""


@query("reassign_straddling_groups", f"SELECT m.path, m.grp, m.split, s.role, s.straddled FROM manifest m JOIN ({SQL_STRADDLE}) s ON m.grp=s.grp", ("manifest",))
def _(spark, sf):
    return sp.reassign_straddling_groups(fx.manifest_table(spark, sf)).select("path", "grp", "split", "role", "straddled")


@query("manifest_row_index", "SELECT path, label, split, pos FROM indexed", ("indexed",))
def _(spark, sf):
    return sp.manifest_row_index(fx.manifest_table(spark, sf)).select("path", "label", "split", "pos")


@query("stratified_row_split", f"""SELECT path, label, CASE WHEN rk<=round_even(n*0.15::DOUBLE,0) THEN 'valid' ELSE 'train' END AS role FROM (
SELECT path, label, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(42, 'row', 'path')}, path) AS rk, count(*) OVER (PARTITION BY label) AS n FROM manifest)""", ("manifest",))
def _(spark, sf):
    return sp.stratified_row_split(fx.manifest_table(spark, sf).select("path", "label"), 0.15, 42)


SQL_POOL = "(SELECT * FROM manifest WHERE split IN ('train','valid'))"
SQL_MAJOR = f"(SELECT grp, arg_min(label, (-n, label)) AS major FROM (SELECT grp, label, count(*) AS n FROM {SQL_POOL} GROUP BY ALL) GROUP BY grp)"


@query("group_resplit", f"""SELECT p.path, p.grp, g.role FROM {SQL_POOL} p JOIN (SELECT grp, CASE WHEN rk<=greatest(1,round_even(n*0.2::DOUBLE,0)) THEN 'valid' ELSE 'train' END AS role FROM (
SELECT grp, row_number() OVER (PARTITION BY major ORDER BY {sql_seed(42, 'resplit', 'grp')}, grp) AS rk, count(*) OVER (PARTITION BY major) AS n FROM {SQL_MAJOR})) g ON p.grp=g.grp""", ("manifest",))
def _(spark, sf):
    return sp.group_resplit(fx.manifest_table(spark, sf), 0.2, 42).select("path", "grp", "role")


@query("fresh_group_split", f"""SELECT m.path, m.grp, g.role FROM manifest m JOIN (SELECT grp, CASE WHEN rk<=greatest(1,round_even(n*0.25::DOUBLE,0)) THEN 'test'
WHEN rk<=greatest(1,round_even(n*0.25::DOUBLE,0))+greatest(1,round_even(n*0.2::DOUBLE,0)) THEN 'valid' ELSE 'train' END AS role FROM (
SELECT grp, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(42, 'fresh', 'grp')}, grp) AS rk, count(*) OVER (PARTITION BY label) AS n FROM (
SELECT grp, arg_min(label, (-n, label)) AS label FROM (SELECT grp, label, count(*) AS n FROM manifest GROUP BY ALL) GROUP BY grp))) g ON m.grp=g.grp""", ("manifest",))
def _(spark, sf):
    return sp.fresh_group_split(fx.manifest_table(spark, sf), 42).select("path", "grp", "role")


@query("group_kfold_train_valid", f"""SELECT CAST(k AS INT) AS fold, p.path, p.label, p.grp, CASE WHEN f.own=k THEN 'valid' ELSE 'train' END AS role FROM {SQL_POOL} p JOIN (
SELECT grp, (row_number() OVER (PARTITION BY major ORDER BY {sql_seed(42, 'fold', 'grp')}, grp)-1)%5 AS own FROM {SQL_MAJOR}) f ON p.grp=f.grp, range(0,5) r(k)""", ("manifest",))
def _(spark, sf):
    return sp.group_kfold_train_valid(fx.manifest_table(spark, sf), 5, 42)


@query("fold_pool_index", f"""SELECT path, pos FROM (SELECT path, row_number() OVER (PARTITION BY split ORDER BY label, path)-1 AS pos, split FROM manifest) WHERE split='train'""", ("manifest",))
def _(spark, sf):
    m = fx.manifest_table(spark, sf)
    pool = sp.manifest_row_index(m).where("split = 'train'").select("path", "pos")
    rows = m.where("split = 'train'").select("path")
    return joins.fold_pool_index(rows, pool).select("path", "pos")


SQL_LEAKED = "(SELECT t.path, min(x.path) AS partner, min(x.label) AS partner_label FROM manifest t JOIN manifest x ON t.grp=x.grp AND x.split='test' WHERE t.split='train' GROUP BY t.path)"


def exact_leaks(m: DataFrame) -> DataFrame:
    """Train rows that are exact copies of a test row: (path, partner, partner_label)."""
    first = m.where("split = 'test'").groupBy("grp").agg(
        F.min("path").alias("partner"), F.min("label").alias("partner_label"))
    return m.where("split = 'train'").select("path", "grp").join(first, "grp").select("path", "partner", "partner_label")


@query("remove_leaked_rows", f"SELECT path, label FROM manifest WHERE split='train' AND path NOT IN (SELECT path FROM {SQL_LEAKED})", ("manifest",))
def _(spark, sf):
    m = fx.manifest_table(spark, sf)
    return ma.remove_leaked_rows(m.where("split = 'train'"), exact_leaks(m)).select("path", "label")


@query("check_removal_mask", f"""SELECT 'unknown_row_in_mask' AS rule, count(*) AS violations FROM (SELECT path FROM {SQL_LEAKED} UNION SELECT path||'.gone' FROM {SQL_LEAKED}) WHERE path NOT IN (SELECT path FROM manifest WHERE split='train')
UNION ALL SELECT 'empty_mask', 0""", ("manifest",))
def _(spark, sf):
    m = fx.manifest_table(spark, sf)
    leaks = exact_leaks(m).select("path")
    mask = leaks.unionByName(leaks.select(F.concat("path", F.lit(".gone")).alias("path")))
    return ma.check_mask(m.where("split = 'train'"), mask)


@query("dedup_removal_summary", f"""SELECT coalesce(p.label,'ALL') AS label, count(*) AS pool, count(l.partner) AS removed, count(*)-count(l.partner) AS surviving,
round(count(l.partner)/count(*)::DOUBLE,6) AS removed_fraction, count(DISTINCT l.partner) AS partners, count(*) FILTER (WHERE l.partner_label<>p.label) AS cross_label
FROM manifest p LEFT JOIN {SQL_LEAKED} l ON p.path=l.path WHERE p.split='train' GROUP BY ROLLUP (p.label)""", ("manifest",))
def _(spark, sf):
    m = fx.manifest_table(spark, sf)
    return r6(ma.dedup_removal_summary(m.where("split = 'train'"), exact_leaks(m)))


@query("integrity_diff", """SELECT coalesce(a.path,b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'new' ELSE 'changed' END AS status
FROM manifest a FULL JOIN hashes_now b ON a.path=b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha256<>b.sha256""", ("manifest", "hashes_now"))
def _(spark, sf):
    return ma.integrity_diff(fx.manifest(spark, sf), fx.hashes_now(spark, sf))


def sql_cross(key: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{a}' AS role_a, '{b}' AS role_b, count(*) AS shared FROM (
SELECT DISTINCT {key} FROM manifest WHERE split='{a}' INTERSECT SELECT DISTINCT {key} FROM manifest WHERE split='{b}')"""
                              for a, b in (("train", "valid"), ("train", "test"), ("valid", "test")))


@query("role_crossing_groups", sql_cross("grp"), ("manifest",))
def _(spark, sf):
    return ma.role_crossing_groups(fx.manifest_table(spark, sf))


@query("file_overlap", sql_cross("sha256"), ("manifest",))
def _(spark, sf):
    return ma.file_overlap(fx.manifest_table(spark, sf))


@query("cohorts_identical", """SELECT (SELECT count(*) FROM manifest WHERE split='test')-count(*) AS only_in_a, 0::BIGINT AS only_in_b, count(*) FILTER (WHERE a.pos<>b.pos) AS moved,
(SELECT count(*) FROM manifest WHERE split='test')=count(*) AS a_nested_in_b,
(SELECT count(*) FROM manifest WHERE split='test')=count(*) AND count(*) FILTER (WHERE a.pos<>b.pos)=0 AS identical
FROM (SELECT path, row_number() OVER (ORDER BY label, path)-1 AS pos FROM manifest WHERE split='test') a
JOIN (SELECT path, row_number() OVER (ORDER BY label, path)-1 AS pos FROM manifest m WHERE split='test' AND grp NOT IN (SELECT grp FROM manifest WHERE split='train')) b ON a.path=b.path""", ("manifest",))
def _(spark, sf):
    m = fx.manifest_table(spark, sf)
    a = sp.manifest_row_index(m.where("split = 'test'"))
    unseen = m.where("split = 'test'").join(m.where("split = 'train'").select("grp"), "grp", "left_anti")
    return ma.cohorts_identical(a, sp.manifest_row_index(unseen))


@query("partition_reconstructs_pool", """SELECT label, count(*) AS published, count(*) AS rebuilt, true AS reconstructs FROM manifest WHERE split='train' GROUP BY label""", ("manifest",))
def _(spark, sf):
    pool = fx.manifest_table(spark, sf).where("split = 'train'")
    return ma.partition_reconstructs_pool(sp.carve_validation(pool, 0.15, 42), pool)


cte("cg", f"""SELECT label, grp, n, row_number() OVER (PARTITION BY label ORDER BY {sql_seed(42, 'carve', 'grp')}, grp) AS rk FROM (
SELECT label, grp, count(*) AS n FROM manifest WHERE split='train' GROUP BY ALL)""", "manifest")
cte("walk", """/* RECURSIVE_STEP */ SELECT label, 0::BIGINT AS rk, CAST(round_even(sum(n)*0.15::DOUBLE,0) AS BIGINT) AS room, NULL::VARCHAR AS grp, false AS take, 0::BIGINT AS n FROM cg GROUP BY label
UNION ALL SELECT w.label, g.rk, CASE WHEN g.n<=w.room THEN w.room-g.n ELSE w.room END, g.grp, g.n<=w.room, g.n FROM walk w JOIN cg g ON g.label=w.label AND g.rk=w.rk+1""", "cg")


@query("exact_count_carve", "SELECT label, grp, n FROM walk WHERE take", ("walk",))
def _(spark, sf):
    pool = fx.manifest_table(spark, sf).where("split = 'train'")
    sizes = pool.groupBy("label", "grp").agg(F.count(F.lit(1)).alias("n"))
    return sp.exact_count_carve(sizes, sp.carve_targets(pool, 0.15), 42)


@query("content_group_audit", """SELECT c.label, count(*) AS content_groups, count(*) FILTER (WHERE c.n>1) AS multi_copy_groups,
count(*) FILTER (WHERE w.grp IS NOT NULL) AS valid_groups, CAST(coalesce(sum(c.n) FILTER (WHERE w.grp IS NOT NULL),0) AS BIGINT) AS valid_rows,
CAST(coalesce(sum(c.n) FILTER (WHERE w.grp IS NULL),0) AS BIGINT) AS train_rows, CAST(round_even(sum(c.n)*0.15::DOUBLE,0) AS BIGINT) AS target
FROM cg c LEFT JOIN (SELECT * FROM walk WHERE take) w ON c.grp=w.grp AND c.label=w.label GROUP BY c.label""", ("walk",))
def _(spark, sf):
    pool = fx.manifest_table(spark, sf).where("split = 'train'")
    return ma.content_group_audit(sp.carve_validation(pool, 0.15, 42), sp.carve_targets(pool, 0.15))


SQL_FZ = "(SELECT run, min(seq) AS fs FROM ledger WHERE kind='freeze' GROUP BY run)"


@query("ledger_audit", f"""SELECT l.run, CAST(sum((kind='decision' AND (fs IS NULL OR seq<fs))::INT) AS BIGINT) AS decisions_before_freeze,
CAST(sum((kind='decision' AND fs IS NOT NULL AND seq>=fs)::INT) AS BIGINT) AS decisions_after_freeze,
CAST(sum((kind='decision' AND split_used='test')::INT) AS BIGINT) AS decisions_on_test,
CAST(sum((kind='read' AND (fs IS NULL OR seq<fs))::INT) AS BIGINT) AS reads_before_freeze, CAST(sum((kind='read')::INT) AS BIGINT) AS reads,
CAST(min(ov.o) AS BIGINT) AS reads_over_limit, min(ov.p) AS purposes_read, bool_or(fs IS NOT NULL) AS frozen
FROM ledger l LEFT JOIN {SQL_FZ} f ON l.run=f.run
JOIN (SELECT run, sum(greatest(r-1,0)) AS o, count(*) FILTER (WHERE r>0) AS p FROM (SELECT run, kind, purpose, count(*) FILTER (WHERE kind='read') AS r FROM ledger WHERE kind IN ('decision','read') GROUP BY ALL) GROUP BY run) ov ON ov.run=l.run
WHERE kind IN ('decision','read') GROUP BY l.run""", ("ledger",))
def _(spark, sf):
    return audits.ledger_audit(fx.ledger(spark, sf))


@query("frozen_config_digest", sql_digest("(SELECT * FROM ledger WHERE kind='decision')", "run", "seq", "knob||chr(1)||value"), ("ledger",))
def _(spark, sf):
    return ma.frozen_config_digest(fx.ledger(spark, sf).where("kind = 'decision'"))


_KEPT = "NOT (CAST(run AS BIGINT)%7=0 AND seq%2=0) AND CAST(run AS BIGINT)%11<>3"


@query("frozen_config_mismatch", f"""SELECT coalesce(a.run,b.run) AS run, a.digest AS recorded, b.digest AS recomputed FROM (
{sql_digest(f"(SELECT * FROM ledger WHERE kind='decision' AND {_KEPT})", "run", "seq", "knob||chr(1)||value")}) a
FULL JOIN ({sql_digest("(SELECT * FROM ledger WHERE kind='decision')", "run", "seq", "knob||chr(1)||value")}) b ON a.run=b.run
WHERE a.digest IS DISTINCT FROM b.digest""", ("ledger",))
def _(spark, sf):
    now = fx.ledger(spark, sf).where("kind = 'decision'")
    then = now.where(_KEPT)
    return ma.digest_mismatch(ma.frozen_config_digest(then), ma.frozen_config_digest(now), "run")


@query("requested_vs_effective", """SELECT role, count(*) AS binds, count(*) FILTER (WHERE requested<>effective) AS substituted, min(effective)=max(effective) AS uniform,
string_agg(DISTINCT requested::VARCHAR, ';' ORDER BY requested::VARCHAR) AS requested, string_agg(DISTINCT effective::VARCHAR, ';' ORDER BY effective::VARCHAR) AS effective,
string_agg(DISTINCT note, ';' ORDER BY note) AS note FROM (SELECT event_type AS role, 1+event_id%2*2 AS requested, CASE WHEN event_type='view' OR event_id%3=0 THEN 1 ELSE 1+event_id%2*2 END AS effective,
CASE WHEN (event_type='view' OR event_id%3=0) AND event_id%2=1 THEN 'served un-augmented on '||event_type END AS note FROM events) GROUP BY role""")
def _(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr(
        "event_type as role", "1 + event_id % 2 * 2 as requested",
        "case when event_type = 'view' or event_id % 3 = 0 then 1 else 1 + event_id % 2 * 2 end as effective",
        "case when (event_type = 'view' or event_id % 3 = 0) and event_id % 2 = 1 then concat('served un-augmented on ', event_type) end as note")
    return audits.requested_vs_effective(e)


@query("timing_summary", """SELECT fold, count(*) AS fits, round(avg(s),9) AS mean_fit_seconds, round(sum(s),9) AS sum_fit_seconds FROM (
SELECT fold, fit_id, max(fit_seconds) AS s FROM (SELECT candidate%5 AS fold, spec||learner||(candidate//10) AS fit_id, fit_seconds FROM grid) GROUP BY ALL) GROUP BY fold""", ("grid",))
def _(spark, sf):
    g = fx.grid(spark, sf).select((F.col("candidate") % 5).alias("fold"), F.expr("concat(spec, learner, candidate div 10)").alias("fit_id"), "fit_seconds")
    t = ma.timing_summary(g)
    return t.select("fold", "fits", F.round("mean_fit_seconds", 9).alias("mean_fit_seconds"), F.round("sum_fit_seconds", 9).alias("sum_fit_seconds"))


@query("group_disjoint_dataset", f"""SELECT f.split AS old_split, s.role, count(*) AS n, count(DISTINCT f.fam) AS families FROM fam f JOIN (
SELECT fam, arg_max(split, (n, CASE split WHEN 'test' THEN 2 WHEN 'valid' THEN 1 ELSE 0 END)) AS role FROM (SELECT fam, split, count(*) AS n FROM fam GROUP BY ALL) GROUP BY fam) s ON f.fam=s.fam GROUP BY ALL""".replace(
    "FROM fam f", f"FROM fam0 f").replace("FROM fam GROUP", "FROM fam0 GROUP"), ("fam0",))
def _(spark, sf):
    from assay.plans.datasets import group_disjoint_dataset
    d = fx.ids(spark, sf)
    s = ha.h32(F.concat_ws("|", F.lit("split"), "o_orderkey")) % 10
    m = d.select(F.col("raw").alias("path"), F.lit("x").alias("label"),
                 F.when(s < 2, "test").when(s == 2, "valid").otherwise("train").alias("split"))
    out = group_disjoint_dataset(m, "family")
    return out.groupBy(F.col("split").alias("old_split"), "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("families"))


cte("fam0", f"""SELECT {SQL_FAMILY} AS fam, CASE WHEN s<2 THEN 'test' WHEN s=2 THEN 'valid' ELSE 'train' END AS split FROM (
SELECT raw, {H("'split|'||o_orderkey")}%10 AS s FROM ids)""", "ids")


# ---- sources and sinks: written to the shared scratch folder, then read back ----

@query("scan_manifest_csv", f"""SELECT CASE WHEN doc_id%2=0 THEN '/data/' ELSE '/corpus/' END||source||'/'||doc_id||'.png' AS path, lang AS label,
CASE lower(trim({SQL_ALIAS})) WHEN '' THEN 'train' WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'valid' WHEN 'validation' THEN 'valid' ELSE 'test' END AS split,
CASE WHEN doc_id%5=0 THEN NULL ELSE 'g'||(doc_id//3) END AS grp FROM documents""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select(
        F.expr("concat(case when doc_id % 2 = 0 then '/data/' else '' end, source, '/', doc_id, '.png')").alias("path"),
        F.concat(F.lit(" "), "lang", F.lit(" ")).alias("label"), _alias().alias("split"),
        F.expr("case when doc_id % 5 = 0 then ' ' else concat('g', doc_id div 3) end").alias("group"))
    out = scratch_path(spark, "manifest-csv")
    sinks.write_new(d, out, "csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.scan_manifest_csv(spark, out, "/corpus")


@query("scan_class_folder_tree", "SELECT split, label, count(*)>0 AS found FROM manifest GROUP BY ALL", ("manifest",))
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("grp"), "lang", "text", "source", "doc_id", "n_chars")
    s = ha.h32(F.concat_ws("|", F.lit("split"), "doc_id")) % 10
    d = d.select(F.when(s < 2, "testing").when(s == 2, "val").otherwise("Training").alias("split"), F.col("lang").alias("cls"), "text")
    out = scratch_path(spark, "tree")
    d.write.partitionBy("split", "cls").text(out)
    return readers.scan_class_folders(spark, out, r"\.txt$").groupBy("split", "label").agg((F.count(F.lit(1)) > 0).alias("found"))


@query("scan_manifest_json", "SELECT split AS role, pos, path, label, grp FROM indexed", ("indexed",))
def _(spark, sf):
    out = scratch_path(spark, "manifest-json")
    sinks.write_manifest_documents(sp.manifest_row_index(fx.manifest_table(spark, sf)), out)
    return readers.scan_manifest_documents(spark, out)


cte("bedrows", """SELECT 'bed'||(pos//500) AS bed, split AS role, pos%500 AS pos, path, label, grp, 'raw' AS source_bed, upper(split) AS source_split, pos AS source_row,
dense_rank() OVER (PARTITION BY pos//500 ORDER BY label)-1 AS y FROM indexed""", "indexed")


def _beds(spark, sf) -> str:
    """Whole documents of at most 500 rows a role, written and named."""
    out = scratch_path(spark, "manifest-beds")
    m = sp.manifest_row_index(fx.manifest_table(spark, sf)).select(
        F.expr("concat('bed', pos div 500)").alias("bed"), F.col("split").alias("role"), (F.col("pos") % 500).alias("pos"), "path", "label", "grp",
        F.lit("raw").alias("source_bed"), F.upper("split").alias("source_split"), F.col("pos").alias("source_row"))
    sinks.write_whole_manifests(m, out, "/data", "group", 42, "registered")
    return out


@query("scan_whole_manifest", """SELECT bed, '/data' AS root, 'group' AS group_unit, 42::BIGINT AS seed, 'registered' AS builder, role, pos, path, y::INT AS y, label, grp, source_bed,
source_split, source_row, md5(e) AS recorded_digest FROM bedrows JOIN (SELECT bed AS b, role AS r, string_agg(path||chr(0)||y||chr(10), '' ORDER BY pos) AS e
FROM bedrows GROUP BY ALL) ON b=bed AND r=role""", ("bedrows",))
def _(spark, sf):
    return readers.scan_whole_manifest(spark, _beds(spark, sf)).drop("built_at")


@query("manifest_document_mismatch", """SELECT bed, role, count(*)::INT AS entries FROM (SELECT *, row_number() OVER (PARTITION BY bed, role ORDER BY pos) AS i FROM bedrows)
WHERE bed IN (SELECT bed FROM bedrows WHERE role='train' AND pos=7 AND source_row%1000>=500) AND role='train' GROUP BY ALL""", ("bedrows",))
def _(spark, sf):
    # every second bed's training entries get one other path behind the digest's back
    d = spark.read.schema(readers.DOCUMENT).json(_beds(spark, sf)).withColumn("document", F.col("bed"))
    odd = F.substring("bed", 4, 20).cast("bigint") % 2 == 1
    edit = lambda role, s: F.when(odd & (role == "train") & (F.size(s["files"]) > 7), s.withField(
        "files", F.transform(s["files"], lambda x, i: F.when(i == 7, F.concat(x, F.lit("~"))).otherwise(x)))).otherwise(s)
    out = scratch_path(spark, "manifest-edited")
    d.withColumn("splits", F.transform_values("splits", edit)).write.partitionBy("document").json(out)
    return readers.scan_manifest_digests(spark, out).where("recorded <> recomputed").select("bed", "role", "entries")


@query("scan_predictions", f"SELECT fold, method, path, patient_id, y_true, y_pred, {NA('p_0')} AS p_0, {NA('p_3')} AS p_3 FROM preds", ("preds",))
def _(spark, sf):
    out = scratch_path(spark, "preds-csv")
    sinks.write_new(joins.spread_posteriors(fx.preds(spark, sf), fx.K), out, "csv", header=True)
    d = readers.scan_predictions(spark, out)
    return d.select("fold", "method", "path", "patient_id", "y_true", "y_pred",
                    po.nanos(F.get("p", F.lit(0))).alias("p_0"), po.nanos(F.get("p", F.lit(3))).alias("p_3"))


@query("scan_result_files_recursive", "SELECT spec, learner, count(*) AS n, round(sum(fit_seconds),9) AS seconds FROM grid GROUP BY ALL", ("grid",))
def _(spark, sf):
    root = scratch_path(spark, "results")
    g = fx.grid(spark, sf).select("spec", "learner", "fit_seconds")
    for i in range(3):
        sinks.write_new(g.where(F.pmod(ha.h32(F.col("spec")), F.lit(3)) == i), f"{root}/run{i}/selection_grid.csv", "csv", header=True)
    d = readers.scan_result_files(spark, root)
    return d.groupBy("spec", "learner").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("recorded_fit_seconds"), 9).alias("seconds"))


@query("sink_ragged_csv", """SELECT spec, count(*) AS n, count(*) FILTER (WHERE learner='F') AS with_note, count(*) FILTER (WHERE learner<>'F') AS with_members FROM grid GROUP BY spec""", ("grid",))
def _(spark, sf):
    g = fx.grid(spark, sf)
    a = g.where("learner = 'F'").select("candidate", "spec", F.struct("pca", "c").alias("note"), F.lit("bulk").alias("grid"))
    b = g.where("learner <> 'F'").select("candidate", "spec", F.array("pca", "c").alias("members"))
    out = scratch_path(spark, "ragged")
    sinks.write_ragged_csv([a, b], out, drop=("grid",))
    back = readers.read_csv_typed(spark, out, {"candidate": "bigint"})
    assert set(back.columns) == {"candidate", "spec", "note", "members"}
    return back.groupBy("spec").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("with_note"), F.count("members").alias("with_members"))


@query("sink_no_overwrite", "SELECT label, count(*) AS n, true AS refused FROM manifest GROUP BY label", ("manifest",))
def _(spark, sf):
    from pyspark.errors import AnalysisException
    out = scratch_path(spark, "once")
    m = fx.manifest_table(spark, sf)
    sinks.write_new(m, out)
    try:
        sinks.write_new(m.limit(0), out)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(out).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query("run_artifact_record", """SELECT split, count(*) AS n, count(DISTINCT grp) AS n_groups, count(*) FILTER (WHERE label='en') AS n_en FROM manifest GROUP BY split""", ("manifest",))
def _(spark, sf):
    m = fx.manifest_table(spark, sf)
    dig = ma.manifest_digest(sp.manifest_row_index(m), ["split"])
    out = scratch_path(spark, "run-record")
    sinks.write_new(sinks.run_record(m, dig, {"seed": "42", "stage": "report"}), out, "json")
    back = spark.read.schema("settings map<string,string>, splits array<struct<split:string,n:bigint,n_groups:bigint,class_counts:map<string,bigint>,digest:string>>").json(out)
    return back.select(F.explode("splits").alias("s")).select(
        "s.split", "s.n", "s.n_groups", F.try_element_at(F.col("s.class_counts"), F.lit("en")).alias("n_en"))
