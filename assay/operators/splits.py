"""Leakage-safe splits. Groups move as a whole, every draw is a hash order, and no step
sorts a whole class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.functions.hashing import seeded
from assay.operators.metrics import group_majority_label
from assay.operators.ranks import class_sizes, hash_rank, holdout_count, ordered_rank, running_sum
from assay.session import write_and_read

ROLES = ("train", "valid", "test")


def group_labels(manifest: DataFrame, group: str = "grp", label: str = "label", strict: bool = True) -> DataFrame:
    """(group, label) of a manifest whose groups have one label; a conflict is an error. Without ``strict`` a group
    with several labels has a row for each, which ``validate_outer_folds`` reports if their folds differ."""
    if not strict:
        return manifest.select(group, label).distinct()
    g = manifest.groupBy(group).agg(F.min(label).alias(label), F.max(label).alias("_hi"))
    bad = F.raise_error(F.concat(F.lit("group with conflicting labels: "), F.col(group))).cast("string")
    return g.select(group, F.when(F.col(label) == F.col("_hi"), F.col(label)).otherwise(bad).alias(label))


def grouped_stratified_folds(groups: DataFrame, k: int = 5, seed: int = 42, min_groups: int | None = None) -> DataFrame:
    """(group, label) -> outer test fold 0..k-1: shuffle per class, deal round-robin.

    A class with fewer groups than folds is an error.
    """
    g = groups.withColumn("_h", seeded(seed, "fold", F.col("grp")))
    ranked = hash_rank(g, ["label"], "_h", ["grp"])
    sizes = class_sizes(groups, ["label"])
    need = k if min_groups is None else min_groups
    few = F.raise_error(F.concat(F.lit("too few groups in class "), F.col("label"))).cast("int")
    fold = F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")
    return ranked.join(sizes, "label").select(
        "grp", "label", F.when(F.col("size") < need, few).otherwise(fold).alias("fold"))


def validation_holdout(folds: DataFrame, k: int = 5, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(grp, label, fold) -> (fold, grp, label, role) for all k folds: the fold's own groups
    test, a class-wise share of the others valid, the rest train."""
    each = folds.select("grp", "label", F.col("fold").alias("own"),
                        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    rest = each.where("own <> fold").withColumn(
        "_h", seeded(seed, "valid", F.col("fold"), F.col("grp")))
    ranked = hash_rank(rest, ["fold", "label"], "_h", ["grp"])
    sizes = class_sizes(rest, ["fold", "label"])
    picked = ranked.join(sizes, ["fold", "label"]).select(
        "fold", "grp", "label",
        F.when(F.col("rank") <= holdout_count(F.col("size"), fraction), "valid").otherwise("train").alias("role"))
    tests = each.where("own = fold").select("fold", "grp", "label", F.lit("test").alias("role"))
    return picked.unionByName(tests)


def carve_split(manifest: DataFrame, target: str, fraction: float, seed: int = 42) -> DataFrame:
    """Move a share of the train groups of each class to ``target``; a group with several labels moves whole."""
    if not 0 < fraction < 1:
        raise ValueError("split fractions must be between 0 and 1")
    pool = manifest.where("split = 'train'").select("label", "grp").distinct()
    ranked = hash_rank(pool.withColumn("_h", seeded(seed, target, F.col("grp"))), ["label"], "_h", ["grp"])
    sizes = class_sizes(pool, ["label"])
    moved = ranked.join(sizes, "label").where(F.col("rank") <= holdout_count(F.col("size"), fraction)).select(
        "grp", F.lit(True).alias("_moved")).distinct()
    out = manifest.join(moved, "grp", "left")
    take = (F.col("split") == "train") & F.coalesce("_moved", F.lit(False))
    return out.withColumn("split", F.when(take, F.lit(target)).otherwise(F.col("split"))).drop("_moved").select(
        *manifest.columns)


def carve_missing_splits(manifest: DataFrame, val_fraction: float = 0.2, test_fraction: float = 0.2,
                         seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Carve test and valid where the manifest has none; returns the names of what was made."""
    there = manifest.agg(*[F.max(F.col("split") == r).alias(r) for r in ("train", "valid", "test")]).first()
    present = {r for r in ("train", "valid", "test") if there[r]}
    if "train" not in present:
        raise ValueError("a training pool is required")
    made: list[str] = []
    out = manifest
    if "test" not in present:
        out = carve_split(out, "test", test_fraction, seed)
        made.append("test")
    if "valid" not in present:
        share = val_fraction / (1 - test_fraction) if "test" in made else val_fraction
        out = carve_split(out, "valid", share, seed + 1)
        made.append("valid")
    return out, made


def exact_count_carve(rows: DataFrame, want: DataFrame, seed: int = 42, exact: bool = False) -> DataFrame:
    """Per class take whole groups in shuffled order until exactly ``want`` rows are placed,
    passing over groups that do not fit.

    ``rows`` is (label, grp, n): one row per group with its size; ``want`` is (label, want).
    Returns the groups taken as (label, grp, n). With ``exact``, a class whose groups can't fill
    its count that way is an error; without, it gets fewer rows.

    Each round takes the longest prefix that fits, as a running sum over hash buckets. The
    group after it does not fit, so the room left is smaller than that group; the next round
    looks only at later groups that fit the room. Room only shrinks, hence a group passed
    over once can never be placed later and no second pass is needed. Every
    round places at least one group, and hands the driver one row per class.
    """
    # one row per group, read once per round
    order = write_and_read(rows.withColumn("_h", seeded(seed, "carve", F.col("grp"))), "carve")
    # room and position per class; classes are few
    state = {r["label"]: (int(r["want"]), "") for r in want.collect()}
    spark = rows.sparkSession
    taken: list[DataFrame] = []
    unfilled: dict[str, int] = {}
    while live := [(c, room, pos) for c, (room, pos) in state.items() if room > 0]:
        st = spark.createDataFrame(live, "label string, room bigint, pos string")
        fit = order.join(F.broadcast(st), "label").where(
            (F.concat("_h", "grp") > F.col("pos")) & (F.col("n") <= F.col("room")))
        cum = running_sum(fit, ["label"], "_h", ["grp"], "n", "cum")
        # written: the next round and the result read it, neither plans it again
        cum = write_and_read(cum.select("label", "grp", "n", "_h", "cum", "room"), "carve-round")
        taken.append(cum.where(F.col("cum") <= F.col("room")).select("label", "grp", "n"))
        over = F.col("cum") > F.col("room")
        here = F.concat("_h", "grp")
        steps = cum.groupBy("label").agg(
            F.coalesce(F.sum(F.when(~over, F.col("n"))), F.lit(0)).alias("placed"),
            F.min(F.when(over, here)).alias("next_pos")).collect()
        seen = {r["label"]: r for r in steps}
        for c, room, _pos in live:
            r = seen.get(c)
            if r is None or r["next_pos"] is None:  # every fitting group is placed
                if left := room - (int(r["placed"]) if r else 0):
                    unfilled[c] = left
                state[c] = (0, "")
            else:
                state[c] = (room - int(r["placed"]), r["next_pos"])
    if exact and unfilled:
        raise ValueError(f"whole groups cannot fill the counts: {unfilled}")
    if not taken:
        return rows.limit(0).select("label", "grp", "n")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def carve_targets(rows: DataFrame, fraction: float, label: str = "label") -> DataFrame:
    """(label, want): half-even rounded share of the rows of each class."""
    return class_sizes(rows, [label]).select(
        label, F.bround(F.col("size") * F.lit(float(fraction)), 0).cast("bigint").alias("want"))


def carve_validation(pool: DataFrame, fraction: float, seed: int = 42, exact: bool = False) -> DataFrame:
    """Training pool (path, label, grp) with a role column: valid groups are whole content groups."""
    sizes = pool.groupBy("label", "grp").agg(F.count(F.lit(1)).alias("n"))
    picked = exact_count_carve(sizes, carve_targets(pool, fraction), seed, exact).select(
        "label", "grp", F.lit("valid").alias("role"))
    return pool.join(picked, ["label", "grp"], "left").withColumn("role", F.coalesce("role", F.lit("train")))


def nested_subsample(train: DataFrame, targets: DataFrame, seed: int = 43) -> DataFrame:
    """Per-class subsample of a training table to ``targets`` (label, target).

    A class with fewer rows than its target is an error.
    """
    h = train.withColumn("_h", seeded(seed, "subsample", F.col("path")))
    ranked = hash_rank(h, ["label"], "_h", ["path"])
    sizes = class_sizes(train, ["label"])
    need = ranked.join(targets, "label").join(sizes, "label")
    short = F.raise_error(F.concat(F.lit("too few rows in class "), F.col("label"))).cast("boolean")
    keep = F.when(F.col("size") < F.col("target"), short).otherwise(F.col("rank") <= F.col("target"))
    return need.where(keep).select(*train.columns)


def reassign_straddling_groups(manifest: DataFrame) -> DataFrame:
    """A group spanning roles goes whole to its majority role, ties to test, then valid."""
    strict = F.when(F.col("split") == "test", 2).when(F.col("split") == "valid", 1).otherwise(0)
    counts = manifest.groupBy("grp", "split").agg(F.count(F.lit(1)).alias("n"))
    role = counts.groupBy("grp").agg(
        F.max_by("split", F.struct(F.col("n"), strict.alias("s"))).alias("role"),
        (F.count(F.lit(1)) > 1).alias("straddled"))
    return manifest.join(role, "grp")


def fresh_group_split(manifest: DataFrame, seed: int = 42, test_share: float = 0.25,
                      valid_share: float = 0.2) -> DataFrame:
    """New roles for whole groups, by majority class: a share test, a share valid, the rest train."""
    major = group_majority_label(manifest, "grp", "label")
    ranked = hash_rank(major.withColumn("_h", seeded(seed, "fresh", F.col("grp"))), ["label"], "_h", ["grp"])
    sizes = class_sizes(major, ["label"])
    j = ranked.join(sizes, "label")
    n_te = holdout_count(F.col("size"), test_share, keep_one=False)
    n_va = holdout_count(F.col("size"), valid_share, keep_one=False)
    role = (F.when(F.col("rank") <= n_te, "test").when(F.col("rank") <= n_te + n_va, "valid").otherwise("train"))
    return manifest.drop("role").join(j.select("grp", role.alias("role")), "grp")


def manifest_row_index(manifest: DataFrame) -> DataFrame:
    """0-based, class-major position of each row within its split (label, then path).

    Ranks are taken within (split, label) and shifted by the size of the classes before, a
    table of splits x classes, so no window ever spans a split.
    """
    from pyspark.sql import Window

    ranked = ordered_rank(manifest, ["split", "label"], "path", "_rank")
    sizes = class_sizes(manifest, ["split", "label"])
    before = Window.partitionBy("split").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("split", "label", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_off"))
    return ranked.join(F.broadcast(offs), ["split", "label"]).withColumn(
        "pos", (F.col("_rank") + F.col("_off") - 1).cast("bigint")).drop("_rank", "_off")


def stratified_row_split(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Row-level stratified split with exact class counts. Leaky for grouped rows."""
    h = rows.withColumn("_h", seeded(seed, "row", F.col("path")))
    ranked = hash_rank(h, ["label"], "_h", ["path"])
    sizes = class_sizes(rows, ["label"])
    n = F.bround(F.col("size") * F.lit(float(fraction)), 0)
    return ranked.join(sizes, "label").withColumn(
        "role", F.when(F.col("rank") <= n, "valid").otherwise("train")).drop("_h", "rank", "size")


def group_resplit(manifest: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Pool train and valid, redraw valid by whole groups per majority class."""
    pool = manifest.where(F.col("split").isin("train", "valid"))
    major = group_majority_label(pool, "grp", "label").withColumnRenamed("label", "major")
    ranked = hash_rank(major.withColumn("_h", seeded(seed, "resplit", F.col("grp"))), ["major"], "_h", ["grp"])
    sizes = class_sizes(major, ["major"])
    role = F.when(F.col("rank") <= holdout_count(F.col("size"), fraction, keep_one=False), "valid").otherwise("train")
    return pool.join(ranked.join(sizes, "major").select("grp", role.alias("role")), "grp")


def group_kfold_train_valid(manifest: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(fold, path, role) over train and valid only, by majority class of whole groups."""
    pool = manifest.where(F.col("split").isin("train", "valid"))
    major = group_majority_label(pool, "grp", "label")
    folds = grouped_stratified_folds(major, k, seed, min_groups=1)
    j = pool.join(folds.select("grp", F.col("fold").alias("own")), "grp")
    each = j.select("path", "label", "grp", "own", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return each.select("fold", "path", "label", "grp",
                       F.when(F.col("own") == F.col("fold"), "valid").otherwise("train").alias("role"))
