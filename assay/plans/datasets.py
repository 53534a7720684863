"""Dataset builders: from raw rows to a checked, leakage-safe manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.functions.hashing import content_sha256
from assay.functions.text import group_key
from assay.operators import audits, manifests as ma, splits as sp


def prepare_manifest(rows: DataFrame, content: DataFrame, val_fraction: float = 0.2, test_fraction: float = 0.2,
                     seed: int = 42, strict: bool = True) -> dict[str, DataFrame]:
    """Validate, carve the splits that are missing, validate again, hash the content.

    ``rows`` is (path, label, split, grp); ``content`` is (path, content). Without any group
    each row is its own group. Nothing is dropped, balanced or deduplicated. Groups with several
    labels are an error; without ``strict`` they are kept and each moves whole.
    """
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.trim("grp"), F.lit(""))).alias("g")).first()
    if not counts["n"]:
        raise ValueError("empty dataset")
    if 0 < counts["g"] < counts["n"]:
        raise ValueError("some groups are missing; supply all or none")
    if not counts["g"]:
        rows = rows.withColumn("grp", F.concat(F.lit("image:"), "path"))
    free = [] if strict else ["group_crosses_labels"]
    held = lambda d, *more: audits.validate_manifest(d).where(~F.col("rule").isin(*free, *more))
    audits.require_clean(held(rows, "class_missing_in_split"))
    out, made = sp.carve_missing_splits(rows, val_fraction, test_fraction, seed)
    audits.require_clean(held(out))
    hashed = out.join(content, "path").select(*out.columns, content_sha256(F.col("content")).alias("sha256"))
    return {"manifest": hashed, "summary": ma.split_summary(hashed), "generated": made}


def group_disjoint_dataset(rows: DataFrame, unit: str) -> DataFrame:
    """Regroup an existing split by identifier or family; straddling groups move whole."""
    keyed = rows.withColumn("grp", group_key(F.col("path"), unit))
    out = sp.reassign_straddling_groups(keyed)
    return out


def published_split_dataset(rows: DataFrame, expected: DataFrame, valid_fraction: float = 0.15, seed: int = 42,
                            strict: bool = True, exact: bool = True) -> dict[str, DataFrame]:
    """Adopt the published train and test rows, check them against the published counts, carve
    valid out of train per class with content groups (``grp``) kept whole. Unless ``exact`` is off, a
    class whose groups can't give the exact count is an error.

    ``rows`` is (path, label, split, grp), ``expected`` (release, split, label, published).
    """
    if not 0 < valid_fraction < 0.5:
        raise ValueError("valid_fraction must lie in (0, 0.5)")
    check = ma.corpus_fingerprint_check(rows, expected)
    if strict and not check.where("release_match").limit(1).count():
        raise ValueError("the rows match no published release")
    pool = rows.where("split = 'train'")
    thin = sp.carve_targets(pool, valid_fraction).where("want < 2").limit(1).count()
    if thin:
        raise ValueError("a class would get fewer than two valid rows")
    carved = sp.carve_validation(pool, valid_fraction, seed, exact)
    tests = rows.where("split = 'test'").withColumn("role", F.lit("test"))
    out = carved.select("path", "label", "grp", "role").unionByName(tests.select("path", "label", "grp", "role"))
    return {
        "manifest": out, "fingerprint": check, "rebuilt": ma.partition_reconstructs_pool(carved, pool),
        "groups": ma.content_group_audit(carved, sp.carve_targets(pool, valid_fraction)),
        "overlap": ma.role_crossing_groups(out.withColumnRenamed("role", "split")),
    }


def deduplicated_dataset(rows: DataFrame, side: int, valid_fraction: float = 0.15, seed: int = 42,
                         exact: bool = True) -> DataFrame:
    """The same test rows; train rows that are the same picture as a test row are removed, then
    valid is carved from the survivors by whole components of the duplicate relation.

    ``rows`` is (id, v, label, role in train/test); returns (id, label, role) with removed rows
    marked, so that every input row is accounted for.
    """
    from assay.operators import dedup as dd
    from assay.session import write_and_read

    pool, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    leaked = write_and_read(dd.leaked_rows_best_partner(pool.select("id", "v"), test.select("id", "v"), side), "leaked")
    kept = pool.join(leaked.select("id"), "id", "left_anti")
    relation = dd.strict_items(kept.select("id", "v"), side)
    comp = write_and_read(dd.duplicate_components(relation, kept.select("id")), "components")
    carve = kept.select("id", "label").join(comp.select("id", F.col("component").cast("string").alias("grp")), "id")
    done = sp.carve_validation(carve, valid_fraction, seed, exact)
    gone = pool.join(leaked.select("id"), "id", "left_semi").select("id", "label", F.lit("removed").alias("role"))
    return done.select("id", "label", "role").unionByName(gone).unionByName(test.select("id", "label", "role"))


def balanced_and_subsampled_pair(rows: DataFrame, valid_per_class: int, share, seed: int = 42, exact: bool = True) -> DataFrame:
    """Two datasets with the same valid and test rows: one with class-balanced train rows, one
    with a nested per-class subsample of them. ``share`` is a column over the label.
    """
    pool = rows.where("split = 'train'")
    sizes = pool.groupBy("label", "grp").agg(F.count(F.lit(1)).alias("n"))
    want = sizes.groupBy("label").agg(F.lit(valid_per_class).cast("bigint").alias("want"))
    picked = sp.exact_count_carve(sizes, want, seed, exact).select("label", "grp", F.lit(True).alias("v"))
    marked = pool.join(picked, ["label", "grp"], "left").withColumn("v", F.coalesce("v", F.lit(False)))
    rest = marked.where(~F.col("v")).select("path", "label")
    per_class = rest.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    low = per_class.agg(F.min("n").alias("target"))
    balanced = sp.nested_subsample(rest, per_class.join(F.broadcast(low)).select("label", "target"), seed + 1)
    targets = per_class.join(F.broadcast(low)).select("label", F.floor(F.col("target") * share).alias("target"))
    sub = sp.nested_subsample(balanced, targets, seed + 2)
    shared = marked.where("v").select("path", "label", F.lit("valid").alias("role")).unionByName(
        rows.where("split = 'test'").select("path", "label", F.lit("test").alias("role")))
    both = shared.withColumn("dataset", F.explode(F.array(F.lit("balanced"), F.lit("subsampled"))))
    train = balanced.select(F.lit("balanced").alias("dataset"), "path", "label", F.lit("train").alias("role")).unionByName(
        sub.select(F.lit("subsampled").alias("dataset"), "path", "label", F.lit("train").alias("role")))
    return train.unionByName(both.select("dataset", "path", "label", "role"))
