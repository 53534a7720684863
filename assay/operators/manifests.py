"""Manifest tables: labels, digests, summaries, set relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.functions.text import NORMAL_ALIASES_ANY, NORMAL_ALIASES_RANKED, normalize_class_name
from assay.operators.ranks import ordered_rank

DIGEST_FAN_IN = 4096


def class_table(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, idx): index in the sorted distinct labels, however many there are."""
    ranked = ordered_rank(rows.select(label).distinct().withColumn("_all", F.lit(0)), ["_all"], label, "_rank")
    return ranked.select(label, (F.col("_rank") - 1).cast("int").alias("idx"))


def label_encode(rows: DataFrame, label: str = "label", out: str = "y") -> DataFrame:
    """Adds the 0-based index of the label in sorted order."""
    return rows.join(class_table(rows, label).withColumnRenamed("idx", out), label)


def find_normal_class(classes: DataFrame, requested: str | None = None, ranked: bool = True) -> DataFrame:
    """One row: index of the normal class.

    ``ranked`` takes the first alias that is present and gives null when nothing fits;
    otherwise classes are scanned in order, and a requested class that is absent is an error.
    """
    name = normalize_class_name(F.col("label"))
    if requested and requested.lower() not in ("auto", "none", ""):
        want = normalize_class_name(F.lit(requested))
        hit = classes.agg(F.min(F.when(name == want, F.col("idx"))).alias("normal_idx"))
        if ranked:
            return hit
        gone = F.raise_error(F.lit(f"class not found: {requested}")).cast("int")
        return hit.select(F.coalesce("normal_idx", gone).alias("normal_idx"))
    if ranked:
        rank = F.array_position(F.array(*[F.lit(a) for a in NORMAL_ALIASES_RANKED]), name)
        return classes.agg(F.min_by("idx", F.when(rank > 0, rank)).alias("normal_idx"))
    return classes.agg(F.min(F.when(name.isin(*NORMAL_ALIASES_ANY), F.col("idx"))).alias("normal_idx"))


def ordered_digest(rows: DataFrame, keys: list[str], pos: str, item: Column) -> DataFrame:
    """One md5 per key that changes if and only if the items or their order change.

    Three levels of at most 4096 hashes each, so a key with billions of rows never
    gathers its items in one place.
    """
    def level(df: DataFrame, group: list[str]) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col("_p"), F.col("_h"))))
        joined = F.array_join(F.transform(ordered, lambda s: s["_h"]), "")
        return df.groupBy(*group).agg(F.md5(joined).alias("_h"))

    w = DIGEST_FAN_IN
    base = rows.select(
        *keys, F.col(pos).alias("_p"), F.md5(item).alias("_h"),
        F.floor(F.col(pos) / w).alias("_b1"), F.floor(F.col(pos) / (w * w)).alias("_b2"))
    one = level(base, [*keys, "_b2", "_b1"]).withColumnRenamed("_b1", "_p")
    two = level(one, [*keys, "_b2"]).withColumnRenamed("_b2", "_p")
    return level(two, keys).withColumnRenamed("_h", "digest")


def manifest_digest(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Order-sensitive digest of (path, label) per key; needs the position column ``pos``."""
    return ordered_digest(manifest, keys, "pos", F.concat_ws("\x01", "path", "label"))


def frozen_config_digest(decisions: DataFrame) -> DataFrame:
    """Digest over the ordered (knob, value) decisions of each run."""
    return ordered_digest(decisions, ["run"], "seq", F.concat_ws("\x01", "knob", "value"))


def digest_mismatch(recorded: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """Keys whose recomputed digest differs from the recorded one."""
    a = recorded.select(key, F.col("digest").alias("recorded"))
    b = recomputed.select(key, F.col("digest").alias("recomputed"))
    return a.join(b, key, "full_outer").where(~F.col("recorded").eqNullSafe(F.col("recomputed")))


def split_summary(manifest: DataFrame) -> DataFrame:
    """Rows per (split, label) with totals, and the distinct groups of each split."""
    counts = manifest.rollup("split", "label").agg(F.count(F.lit(1)).alias("rows"))
    per_split = manifest.groupBy("split").agg(F.count_distinct("grp").alias("groups"))
    groups = per_split.select("split", "groups")
    return (counts.join(F.broadcast(groups), "split", "left")
            .select(F.coalesce("split", F.lit("ALL")).alias("split"), F.coalesce("label", F.lit("ALL")).alias("label"),
                    "rows", F.when(F.col("label").isNull(), F.col("groups")).alias("groups")))


def corpus_fingerprint_check(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed against published counts per (split, label); ``expected`` may hold several
    releases, and ``release_match`` says whether a whole release fits."""
    seen = manifest.groupBy("split", "label").agg(F.count(F.lit(1)).alias("observed"))
    releases = expected.select("release").distinct()
    # releases x classes: both are class-table sized
    grid = seen.join(F.broadcast(releases))
    j = grid.join(expected, ["release", "split", "label"], "full_outer").select(
        "release", "split", "label", F.coalesce("observed", F.lit(0)).alias("observed"), "published")
    j = j.withColumn("matches", F.coalesce(F.col("observed") == F.col("published"), F.lit(False)))
    fit = j.groupBy("release").agg(F.min("matches").alias("release_match"))
    return j.join(F.broadcast(fit), "release")


def integrity_diff(expected: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) for every path that is changed, missing or new."""
    a = expected.select("path", F.col("sha256").alias("was"))
    b = current.select("path", F.col("sha256").alias("now"))
    status = (F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new")
              .when(F.col("was") != F.col("now"), "changed"))
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def role_crossing_groups(manifest: DataFrame) -> DataFrame:
    """(role_a, role_b, shared): groups present in both roles, each pair listed, 0 included."""
    g = manifest.groupBy("grp").agg(*[
        F.max(F.when(F.col("split") == r, 1).otherwise(0)).alias(r) for r in ("train", "valid", "test")])
    pairs = [("train", "valid"), ("train", "test"), ("valid", "test")]
    sums = g.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("bigint").alias(f"{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("role_a"), F.lit(b).alias("role_b"), F.col(f"{a}_{b}").alias("shared"))
                     for a, b in pairs])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def file_overlap(manifest: DataFrame, key: str = "sha256") -> DataFrame:
    """Size of the pairwise role intersections of a content key."""
    return role_crossing_groups(manifest.select(F.col(key).alias("grp"), "split"))


def cohorts_identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: are two cohorts the same rows in the same order, and is a inside b.

    Both sides carry (pos, path, label).
    """
    left = a.select("pos", "path", "label", F.lit(1).alias("_a"))
    right = b.select(F.col("pos").alias("pos_b"), "path", "label", F.lit(1).alias("_b"))
    j = left.join(right, ["path", "label"], "full_outer")
    only = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    return j.agg(
        only(F.col("_b").isNull()).alias("only_in_a"),
        only(F.col("_a").isNull()).alias("only_in_b"),
        only(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("pos") != F.col("pos_b"))).alias("moved"),
    ).select(
        "*", (F.col("only_in_a") == 0).alias("a_nested_in_b"),
        ((F.col("only_in_a") == 0) & (F.col("only_in_b") == 0) & (F.col("moved") == 0)).alias("identical"))


def partition_reconstructs_pool(carved: DataFrame, pool: DataFrame) -> DataFrame:
    """Per class: do the train and valid counts rebuild the published pool."""
    got = carved.where(F.col("role").isin("train", "valid")).groupBy("label").agg(F.count(F.lit(1)).alias("rebuilt"))
    want = pool.groupBy("label").agg(F.count(F.lit(1)).alias("published"))
    j = want.join(got, "label", "full_outer").select(
        "label", F.coalesce("published", F.lit(0)).alias("published"), F.coalesce("rebuilt", F.lit(0)).alias("rebuilt"))
    return j.withColumn("reconstructs", F.col("published") == F.col("rebuilt"))


def remove_leaked_rows(pool: DataFrame, mask: DataFrame) -> DataFrame:
    """Pool rows whose path is not in the mask."""
    return pool.join(mask.select("path").distinct(), "path", "left_anti")


def check_mask(pool: DataFrame, mask: DataFrame) -> DataFrame:
    """(rule, violations): an empty mask and mask rows the pool does not know."""
    m = mask.select("path").distinct()
    unknown = m.join(pool.select("path"), "path", "left_anti").agg(
        F.lit("unknown_row_in_mask").alias("rule"), F.count(F.lit(1)).alias("violations"))
    empty = m.agg(F.lit("empty_mask").alias("rule"),
                  F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("violations"))
    return unknown.unionByName(empty)


def dedup_removal_summary(pool: DataFrame, leaked: DataFrame) -> DataFrame:
    """Per label and in total: pool, removed, surviving, share, partners, cross-label pairs.

    ``leaked`` is (path, partner, partner_label).
    """
    j = pool.select("path", "label").join(leaked, "path", "left")
    gone = F.col("partner").isNotNull()
    return j.rollup("label").agg(
        F.count(F.lit(1)).alias("pool"),
        F.sum(gone.cast("int")).cast("bigint").alias("removed"),
        F.count_distinct("partner").alias("partners"),
        F.coalesce(F.sum((gone & (F.col("partner_label") != F.col("label"))).cast("int")), F.lit(0)).cast("bigint").alias("cross_label"),
    ).select(
        F.coalesce("label", F.lit("ALL")).alias("label"), "pool", "removed",
        (F.col("pool") - F.col("removed")).alias("surviving"),
        F.round(F.col("removed") / F.greatest(F.col("pool"), F.lit(1)), 6).alias("removed_fraction"),
        "partners", "cross_label")


def content_group_audit(carved: DataFrame, targets: DataFrame) -> DataFrame:
    """Per class of a carved pool (label, grp, role): content groups, groups with copies,
    and the groups and rows placed in each role beside the target."""
    g = carved.groupBy("label", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("role") == "valid").cast("int")).alias("nv"))
    a = g.groupBy("label").agg(
        F.count(F.lit(1)).alias("content_groups"),
        F.sum((F.col("n") > 1).cast("int")).cast("bigint").alias("multi_copy_groups"),
        F.sum((F.col("nv") > 0).cast("int")).cast("bigint").alias("valid_groups"),
        F.sum("nv").cast("bigint").alias("valid_rows"),
        F.sum(F.col("n") - F.col("nv")).cast("bigint").alias("train_rows"))
    return a.join(F.broadcast(targets.select("label", F.col("want").alias("target"))), "label")


def duplicate_groups_report(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, redundant copies, groups with copies, the largest
    group, and the groups that cross a split or a class."""
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.min("split") != F.max("split")).alias("xs"),
        (F.min("label") != F.max("label")).alias("xl"))
    cnt = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("n_redundant"),
        cnt(F.col("n") > 1).alias("n_groups_with_copies"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"),
        cnt(F.col("xs")).alias("n_cross_split_groups"), cnt(F.col("xl")).alias("n_cross_class_groups"))


def duplicate_groups_examples(rows: DataFrame, key: str, limit: int = 200) -> DataFrame:
    """The first ``limit`` keys, in key order, whose copies cross a split."""
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"), F.min("split").alias("s0"), F.max("split").alias("s1"),
        F.min("path").alias("first_path"))
    return g.where("s0 <> s1").orderBy(key).limit(limit).select(key, "copies", "first_path")


def timing_summary(log: DataFrame) -> DataFrame:
    """Per fold: distinct fits, mean and sum of their seconds; a reused fit counts once."""
    fits = log.groupBy("fold", "fit_id").agg(F.max("fit_seconds").alias("s"))
    return fits.groupBy("fold").agg(
        F.count(F.lit(1)).alias("fits"), F.avg("s").alias("mean_fit_seconds"), F.sum("s").alias("sum_fit_seconds"))
