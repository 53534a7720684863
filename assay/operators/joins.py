"""Equi-joins on row identity: alignment, pairing, gathering, fusion, pool lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assay.functions.posterior import argmax_lowest, valid_posterior

CASE_COLUMNS = ("path", "patient_id", "fold", "y_true")


def align_methods(preds: DataFrame, reference: str) -> DataFrame:
    """Per method: cases of the reference it misses, cases it adds, and cases that differ.

    One shuffle on the path: the reference values of a path are spread over its rows by an
    aggregate instead of joining the table with itself once per method.
    """
    others = [r["method"] for r in preds.select("method").distinct().collect() if r["method"] != reference]
    case = F.struct("patient_id", "fold", "y_true")
    per_path = preds.groupBy("path").agg(
        F.max(F.when(F.col("method") == reference, case)).alias("ref"),
        *[F.max(F.when(F.col("method") == m, case)).alias(f"m{i}") for i, m in enumerate(others)])
    def cnt(c, name):
        return F.sum(c.cast("int")).cast("bigint").alias(name)
    aggs = []
    for i, _ in enumerate(others):
        mine, ref = F.col(f"m{i}"), F.col("ref")
        aggs += [cnt(ref.isNotNull() & mine.isNull(), f"missing{i}"), cnt(ref.isNull() & mine.isNotNull(), f"extra{i}"),
                 cnt(F.coalesce(ref.isNotNull() & mine.isNotNull() & ~ref.eqNullSafe(mine), F.lit(False)), f"different{i}")]
    wide = per_path.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"missing{i}").alias("missing"),
                              F.col(f"extra{i}").alias("extra"), F.col(f"different{i}").alias("different"))
                     for i, m in enumerate(others)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def paired_predictions(preds: DataFrame, a: str, b: str) -> DataFrame:
    """(path, patient_id, y_true, pred_a, pred_b) of two methods."""
    left = preds.where(F.col("method") == a).select("path", "patient_id", "y_true", F.col("y_pred").alias("pred_a"))
    right = preds.where(F.col("method") == b).select("path", F.col("y_pred").alias("pred_b"))
    return left.join(right, "path")


def paired_vs_baselines(preds: DataFrame, a: str) -> DataFrame:
    """The same for one method against every other, long over ``baseline``."""
    left = preds.where(F.col("method") == a).select("path", "patient_id", "y_true", F.col("y_pred").alias("pred_a"))
    right = preds.where(F.col("method") != a).select(
        "path", F.col("method").alias("baseline"), F.col("y_pred").alias("pred_b"))
    return left.join(right, "path")


def ensemble_posteriors(preds: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """(path, y_true, p): weighted mean of the members' posteriors; one shuffle on the path.

    A path that lacks a member is an error.
    """
    total = sum(weights.values())
    w = F.lit(None).cast("double")
    for name, x in weights.items():
        w = F.when(F.col("method") == name, F.lit(x / total)).otherwise(w)
    d = preds.where(F.col("method").isin(*weights)).withColumn("_w", w)
    out = d.groupBy("path").agg(
        F.first("y_true").alias("y_true"), F.count(F.lit(1)).alias("_m"),
        F.array(*[F.sum(F.col("_w") * F.get("p", F.lit(i))) for i in range(k)]).alias("p"))
    gap = F.raise_error(F.concat(F.lit("member missing for "), F.col("path"))).cast("array<double>")
    return out.select("path", "y_true", F.when(F.col("_m") == len(weights), F.col("p")).otherwise(gap).alias("p"))


def member_posteriors(preds: DataFrame, members: list[str]) -> DataFrame:
    """(path, y_true, ps): posteriors of all members of a path as an array in member order."""
    d = preds.where(F.col("method").isin(*members))
    cols = [F.first(F.when(F.col("method") == m, F.col("p")), ignorenulls=True) for m in members]
    return d.groupBy("path").agg(F.first("y_true").alias("y_true"), F.array(*cols).alias("ps"))


def spread_posteriors(preds: DataFrame, k: int) -> DataFrame:
    """Posterior array to p_0 .. p_{k-1} columns."""
    return preds.select(*[c for c in preds.columns if c != "p"], *[F.get("p", F.lit(i)).alias(f"p_{i}") for i in range(k)])


def build_prediction_rows(rows: DataFrame, k: int) -> DataFrame:
    """Posteriors to prediction rows: checked, labelled by the lowest argmax, spread to columns."""
    y = argmax_lowest(F.col("p"), k)
    v = valid_posterior(F.col("p"), y, k)
    bad = reduce(lambda a, b: a | b, [v["wrong_length"], v["not_finite"], v["negative"], v["sum_not_one"]])
    stop = F.raise_error(F.concat(F.lit("invalid probabilities for "), F.col("path"))).cast("int")
    return spread_posteriors(rows.withColumn("y_pred", F.when(bad, stop).otherwise(y)), k)


PREDICTION_COLUMNS = ["fold", "method", "path", "patient_id", "y_true", "y_pred"]


def merge_predictions(parts: list[DataFrame]) -> DataFrame:
    """Union of prediction sets. Probability columns stay only when every input has the same
    non-empty set of them; they are never filled in."""
    probs = [frozenset(c for c in d.columns if c.startswith("p_")) for d in parts]
    keep = list(PREDICTION_COLUMNS)
    if probs[0] and all(p == probs[0] for p in probs):
        keep += sorted(probs[0])
    return reduce(DataFrame.unionByName, [d.select(*keep) for d in parts])


def union_folds(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gather_features(manifest: DataFrame, features: DataFrame, strict: bool = True) -> DataFrame:
    """Manifest rows with the feature vector found by (source_split, source_row), ``pos`` kept.

    A row without features is an error when ``strict``.
    """
    f = features.select("source_split", "source_row", "backbone", "features", F.col("y").alias("y_features"))
    j = manifest.join(f, ["source_split", "source_row"], "left")
    if not strict:
        return j
    gap = F.raise_error(F.concat(F.lit("no features for "), F.col("path"))).cast("array<float>")
    return j.withColumn("features", F.coalesce("features", gap))


def verify_labels(manifest: DataFrame, features: DataFrame) -> DataFrame:
    """Per block: rows joined, rows without features, labels that disagree."""
    j = gather_features(manifest, features, strict=False)
    return j.groupBy("backbone").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("features").isNull().cast("int")).cast("bigint").alias("missing"),
        F.coalesce(F.sum((F.col("y_features") != F.col("y")).cast("int")), F.lit(0)).cast("bigint").alias("disagree"))


def fuse_blocks(features: DataFrame, spec: str) -> DataFrame:
    """Concatenate the blocks of ``a+b+c`` in that order per path; one shuffle on the path.

    Labels that differ between blocks are an error; a path that lacks a block drops out, as
    in an inner join.
    """
    parts = spec.split("+")
    d = features.where(F.col("backbone").isin(*parts))
    cols = [F.first(F.when(F.col("backbone") == b, F.col("features")), ignorenulls=True).alias(f"b{i}")
            for i, b in enumerate(parts)]
    g = d.groupBy("path").agg(F.min("y").alias("y"), F.max("y").alias("_y"), *cols)
    full = reduce(lambda a, b: a & b, [F.col(f"b{i}").isNotNull() for i in range(len(parts))])
    clash = F.raise_error(F.concat(F.lit("labels differ between blocks: "), F.col("path"))).cast("int")
    return g.where(full).select(
        "path", F.when(F.col("y") == F.col("_y"), F.col("y")).otherwise(clash).alias("y"),
        F.concat(*[F.col(f"b{i}") for i in range(len(parts))]).alias("features"))


def duplicate_pairs_roles(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Role and class on both ends of all duplicate pairs, copies included.

    ``pairs`` is (a, b) over items, a = b for an item whose copies duplicate each other;
    ``members`` is (id, item, role, label). Members of an item that agree in role and label are
    counted, not listed: a row (a, b, role_a, label_a, role_b, label_b, pairs, first_a, first_b)
    stands for all its pairs of members, and names the first of them. Members without a role drop
    out. The rows per pair are bounded by roles and classes, not by copies.
    """
    g = members.where("role is not null").groupBy("item", "role", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    # the second smallest id of a group names a pair inside it
    more = members.join(g, ["item", "role", "label"]).where("id <> first").groupBy("item", "role", "label").agg(F.min("id").alias("second"))
    g = g.join(more, ["item", "role", "label"], "left")
    side = lambda x: g.select(*[F.col(c).alias(c2) for c, c2 in (("item", x), ("role", f"role_{x}"), ("label", f"label_{x}"), ("n", f"n_{x}"), ("first", f"first_{x}"), ("second", f"second_{x}"))])
    j = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    same = (F.col("a") == F.col("b"))
    one, two = F.struct("role_a", "label_a"), F.struct("role_b", "label_b")
    alike = same & (one == two)
    j = j.where(~same | (one <= two)).withColumn(
        "pairs", F.when(alike, (F.col("n_a") * (F.col("n_a") - 1) / 2).cast("bigint")).otherwise(F.col("n_a") * F.col("n_b"))).where("pairs > 0")
    return j.withColumn("first_b", F.when(alike, F.col("second_b")).otherwise(F.col("first_b"))).withColumn(
        "role_pair", F.concat_ws("_", F.array_sort(F.array("role_a", "role_b")))).withColumn(
        "cross_class", F.col("label_a") != F.col("label_b")).select(
        "a", "b", "role_a", "label_a", "role_b", "label_b", "role_pair", "cross_class", "pairs", "first_a", "first_b")


def fold_pool_index(fold_rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Fold rows with their position in the pool; a row outside the pool is an error."""
    j = fold_rows.join(pool.select("path", "pos"), "path", "left")
    gap = F.raise_error(F.concat(F.lit("row outside the pool: "), F.col("path"))).cast("bigint")
    return j.withColumn("pos", F.coalesce("pos", gap))
