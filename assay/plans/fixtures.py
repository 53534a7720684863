"""Evaluation tables derived from the given ones, in Spark and, side by side, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.functions.hashing import h32
from assay.plans.registry import H, cte
from assay.session import spread, write_and_read

METHODS = (("proposed", 90), ("linear_probe", 88), ("vit_rf", 78))
K = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions of three methods, one row per (order, method)."""
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.lit(hit).alias("hit")) for n, hit in METHODS]))
    d = o.withColumn("m", m).select("o_orderkey", "o_custkey", "m.*")
    d = d.withColumn("x", h32(F.concat_ws("|", "method", "o_orderkey"))).selectExpr(
        "cast((o_custkey div 4) % 5 + 1 as int) as fold", "method",
        "concat('o', o_orderkey) as path", "concat('c', o_custkey) as patient_id",
        "cast(o_custkey % 4 as int) as y_true",
        "cast(case when x % 100 < hit then o_custkey % 4 else (o_custkey % 4 + 1 + (x div 100) % 3) % 4 end as int) as y_pred",
        "0.5D + (x % 400) / 1000D as top")
    p = F.array(*[F.when(F.col("y_pred") == i, F.col("top")).otherwise((F.lit(1.0) - F.col("top")) / F.lit(3.0))
                  for i in range(K)])
    return d.withColumn("p", p).drop("top")


def preds_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stored table, for reports that read it several times."""
    return write_and_read(preds(spark, sf), "preds")


_M = ",".join(f"('{n}',{h})" for n, h in METHODS)
cte("preds0", f"""SELECT o_orderkey, o_custkey, method, hit, {H("method||'|'||o_orderkey")} AS x
FROM orders, (VALUES {_M}) m(method, hit)""")
cte("preds1", """SELECT CAST((o_custkey//4)%5+1 AS INT) AS fold, method, 'o'||o_orderkey AS path, 'c'||o_custkey AS patient_id,
CAST(o_custkey%4 AS INT) AS y_true,
CAST(CASE WHEN x%100<hit THEN o_custkey%4 ELSE (o_custkey%4+1+(x//100)%3)%4 END AS INT) AS y_pred,
0.5::DOUBLE+(x%400)/1000::DOUBLE AS top FROM preds0""", "preds0")
cte("preds", "SELECT *, " + ", ".join(
    f"CASE WHEN y_pred={i} THEN top ELSE (1.0::DOUBLE-top)/3.0::DOUBLE END AS p_{i}" for i in range(K)) +
    ", [p_0,p_1,p_2,p_3] AS p FROM preds1", "preds1")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest over the documents. Exact copies of a text can land in different roles."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    s = h32(F.concat_ws("|", F.lit("split"), "doc_id")) % 10
    return d.select(
        F.expr("concat(source, '/', lang, '_', doc_id, '__', n_chars, '.txt')").alias("path"),
        F.col("lang").alias("label"),
        F.when(s < 2, "test").when(s == 2, "valid").otherwise("train").alias("split"),
        F.md5(F.col("text").cast("binary")).alias("grp"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def manifest_table(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest as a stored table: split operators read it several times, and the texts
    behind its hashes should be read once."""
    return write_and_read(manifest(spark, sf), "manifest")


def manifest_flat(spark: SparkSession, sf: str) -> DataFrame:
    """No roles assigned yet: everything is training pool."""
    return manifest(spark, sf).withColumn("split", F.lit("train"))


_SPLIT = "CASE WHEN s<2 THEN 'test' WHEN s=2 THEN 'valid' ELSE 'train' END"
cte("manifest", f"""SELECT path, label, {_SPLIT} AS split, grp, sha256 FROM (
SELECT source||'/'||lang||'_'||doc_id||'__'||n_chars||'.txt' AS path, lang AS label,
{H("'split|'||doc_id")}%10 AS s, md5(text) AS grp, sha256(text) AS sha256 FROM documents)""")
cte("manifest_flat", "SELECT path, label, 'train' AS split, grp, sha256 FROM manifest", "manifest")


def ids(spark: SparkSession, sf: str) -> DataFrame:
    """Raw file names with identifiers and variant letters, half with backslash folders."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        r"concat(case when o_orderkey % 2 = 0 then 'corpus/scans/' else 'corpus\\scans\\' end,"
        " 'MR', lpad(cast(o_custkey as string), 6, '0'), element_at(array('', 'B', 'D'), cast(o_orderkey % 3 as int) + 1),"
        " '__', o_orderkey, '.png') as raw")


cte("ids", r"""SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN 'corpus/scans/' ELSE 'corpus\scans\' END
||'MR'||lpad(o_custkey::VARCHAR,6,'0')||CASE o_orderkey%3 WHEN 0 THEN '' WHEN 1 THEN 'B' ELSE 'D' END
||'__'||o_orderkey||'.png' AS raw FROM orders""")


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Decision logs: one run per user; ``seq`` is the event id, which is unique and ordered."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    purpose = h32(F.col("event_id")) % 3
    return e.select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("seq"),
        F.expr("case event_type when 'click' then 'decision' when 'error' then 'decision' when 'signup' then 'freeze' "
               "when 'view' then 'read' else 'note' end").alias("kind"),
        F.expr("case event_type when 'click' then 'valid' when 'error' then 'test' end").alias("split_used"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("p"), purpose)).alias("purpose"),
        F.concat(F.lit("knob"), F.col("event_id") % 7).alias("knob"),
        F.floor(F.col("value")).cast("bigint").cast("string").alias("value"))


cte("ledger", f"""SELECT user_id::VARCHAR AS run, event_id AS seq,
CASE event_type WHEN 'click' THEN 'decision' WHEN 'error' THEN 'decision' WHEN 'signup' THEN 'freeze' WHEN 'view' THEN 'read' ELSE 'note' END AS kind,
CASE event_type WHEN 'click' THEN 'valid' WHEN 'error' THEN 'test' END AS split_used,
CASE WHEN event_type='view' THEN 'p'||({H("event_id::VARCHAR")}%3) END AS purpose,
'knob'||(event_id%7) AS knob, floor(value)::BIGINT::VARCHAR AS value FROM events""")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Selection grid: one scored configuration per order; scores repeat, so ties occur."""
    x = h32(F.concat_ws("|", F.lit("grid"), "o_orderkey"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("candidate"), F.col("o_orderpriority").alias("spec"),
        F.col("o_orderstatus").alias("learner"),
        F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(0.95).alias("pca"),
        F.element_at(F.array(F.lit(0.1), F.lit(1.5), F.lit(10.0)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("c"),
        (F.lit(0.8) + (x % 150) / F.lit(1000.0)).alias("valid_bal_acc"),
        ((F.floor(x / 150) % 40) / F.lit(100.0)).alias("exp_risk"),
        (F.col("o_totalprice") / 1e5).alias("fit_seconds"))


cte("grid", f"""SELECT o_orderkey AS candidate, o_orderpriority AS spec, o_orderstatus AS learner,
CASE WHEN o_orderkey%2=0 THEN 0.0 ELSE 0.95 END::DOUBLE AS pca,
CASE o_orderkey%3 WHEN 0 THEN 0.1 WHEN 1 THEN 1.5 ELSE 10.0 END::DOUBLE AS c,
0.8::DOUBLE+(x%150)/1000::DOUBLE AS valid_bal_acc, ((x//150)%40)/100::DOUBLE AS exp_risk, o_totalprice/1e5 AS fit_seconds
FROM (SELECT *, {H("'grid|'||o_orderkey")} AS x FROM orders)""")


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Training logs: one run per user, one epoch per event."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"),
        (F.lit(0.5) + (h32(F.concat_ws("|", F.lit("epoch"), "event_id")) % 400) / F.lit(1000.0)).alias("score"))


cte("epochs", f"""SELECT user_id AS run, event_id AS epoch,
0.5::DOUBLE+({H("'epoch|'||event_id")}%400)/1000::DOUBLE AS score FROM events""")


def hashes_now(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest's hashes after some rows changed, went missing or were added."""
    d = manifest(spark, sf).select("path", "sha256", (h32(F.col("path")) % 70).alias("r"))
    kept = d.where("r <> 0").select("path", F.when(F.col("r") == 1, F.md5("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    added = d.where("r = 2").select(F.concat(F.col("path"), F.lit(".new")).alias("path"), "sha256")
    return kept.unionByName(added)


cte("hashes_now", f"""SELECT path, CASE WHEN r=1 THEN md5(sha256) ELSE sha256 END AS sha256 FROM hn0 WHERE r<>0
UNION ALL SELECT path||'.new', sha256 FROM hn0 WHERE r=2""", "hn0")
cte("hn0", f"SELECT path, sha256, {H('path')}%70 AS r FROM manifest", "manifest")


SIDE = 8
# share of noise in the planted copies by id % 25: exact, faint, weak, byte-equal
COPY_NOISE = {0: 0.0, 5: 0.0022, 10: 0.0154}


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8x8 grids with planted copies: turned, brightened and more or less noisy
    ones, and byte-equal ones. Columns id, v, label, folder, role."""
    from assay.functions.vectors import ints, scan_orders

    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    kind = F.col("id") % 25
    orders = F.array(*[ints(o) for o in scan_orders(SIDE)])
    order = F.get(orders, F.floor(F.col("id") / 25).cast("int") % 8)
    amp = F.element_at(F.create_map(*[x for k, a in COPY_NOISE.items() for x in (F.lit(k), F.lit(a))]), kind.cast("int"))
    turned = e.where(kind.isin(*COPY_NOISE)).withColumn("o", order).withColumn("amp", amp).withColumn(
        "w", F.transform("o", lambda i: F.get("v", i)))
    noisy = F.transform("w", lambda x, i: F.lit(1.3) * x + F.lit(0.2) + F.col("amp") * ((i * 7 + F.col("id")) % 5 - 2))
    copies = turned.select((F.col("id") + (1 + F.floor(kind / 5)) * 1000000).alias("id"), noisy.alias("v"), "label")
    equal = e.where(kind == 15).withColumn("id", F.explode(F.array(F.col("id") + 4000000, F.col("id") + 5000000)))
    d = e.unionByName(copies).unionByName(equal)
    s = h32(F.concat_ws("|", F.lit("vrole"), "id")) % 10
    return d.select(
        "id", "v", F.when(h32(F.concat_ws("|", F.lit("vl"), "id")) % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("folder"),
        F.when(s < 2, "test").when(s == 2, "valid").otherwise("train").alias("role"))


def _sql_orders(table_of, one_based=True) -> str:
    rows = ",".join(f"({t},{[int(i) + 1 for i in o]})" for t, o in enumerate(table_of))
    return f"SELECT * FROM (VALUES {rows}) o(t, ord)"


def _register_vector_sql() -> None:
    from assay.functions.vectors import scan_orders, verify_orders

    cte("scan_ord", _sql_orders(scan_orders(SIDE)))
    cte("verify_ord", _sql_orders(verify_orders(SIDE)))
    cte("scan_ord4", _sql_orders(scan_orders(SIDE // 2)))
    cte("vec0", "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings")
    cte("vec1", """SELECT * FROM vec0 UNION ALL
SELECT id+(1+id%25//5)*1000000, list_transform(w, lambda x, i: 1.3::DOUBLE*x+0.2::DOUBLE+amp*(((i-1)*7+id)%5-2)), label FROM (
SELECT id, list_select(v, ord) AS w, label, CASE id%25 WHEN 0 THEN 0.0 WHEN 5 THEN 0.0022 ELSE 0.0154 END::DOUBLE AS amp
FROM vec0 JOIN scan_ord ON t=(id//25)%8 WHERE id%25 IN (0,5,10))
UNION ALL SELECT id+k, v, label FROM vec0, (VALUES (4000000),(5000000)) c(k) WHERE id%25=15""", "vec0", "scan_ord")
    cte("vec", f"""SELECT id, v, CAST(CASE WHEN {H("'vl|'||id")}%7=0 THEN (label+1)%10 ELSE label END AS INT) AS label,
CASE WHEN id%2=0 THEN 'A' ELSE 'B' END AS folder,
CASE WHEN {H("'vrole|'||id")}%10<2 THEN 'test' WHEN {H("'vrole|'||id")}%10=2 THEN 'valid' ELSE 'train' END AS role FROM vec1""", "vec1")
    cte("vu", """SELECT *, list_transform(c, lambda x: x/norm) AS u FROM (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x*x))) AS norm FROM (
SELECT *, list_transform(v, lambda x: x-m) AS c FROM (SELECT *, list_sum(v)/64 AS m FROM vec)))""", "vec")


_register_vector_sql()


# name -> slice of the 64 embedding values
BLOCKS = {"alpha": (0, 16), "beta": (16, 48), "gamma": (48, 64)}
DIMS = {b: hi - lo for b, (lo, hi) in BLOCKS.items()}
CLASSES = 10


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows (path, backbone, role, source_split, source_row, features, y): three blocks
    per embedding."""
    e = table(spark, sf, "embeddings")
    s = F.col("vec_id") % 10
    parts = F.array(*[F.struct(F.lit(b).alias("backbone"), F.slice("embedding", lo + 1, hi - lo).alias("features"))
                      for b, (lo, hi) in BLOCKS.items()])
    return e.select(
        F.concat(F.lit("v"), "vec_id").alias("path"), F.when(s < 2, "test").when(s == 2, "valid").otherwise("train").alias("role"),
        F.when(s < 2, "Test").otherwise("Train").alias("source_split"), F.col("vec_id").alias("source_row"),
        F.col("label").alias("y"), F.explode(parts).alias("b")).select(
        "path", "b.backbone", "role", "source_split", "source_row", "b.features", "y")


_blocks = ",".join(f"('{b}',{lo + 1},{hi})" for b, (lo, hi) in BLOCKS.items())
cte("features", f"""SELECT 'v'||vec_id AS path, backbone, CASE WHEN vec_id%10<2 THEN 'test' WHEN vec_id%10=2 THEN 'valid' ELSE 'train' END AS role,
CASE WHEN vec_id%10<2 THEN 'Test' ELSE 'Train' END AS source_split, vec_id AS source_row, list_transform(embedding[lo:hi], lambda x: x::DOUBLE) AS f, label AS y
FROM embeddings, (VALUES {_blocks}) b(backbone, lo, hi)""")
