"""Validation rules as violation counts: one row per rule, so a report shows every broken
rule at once. ``require_clean`` turns a report into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assay.functions.posterior import valid_posterior
from assay.session import write_and_read

PREDICTION_COLUMNS = ("fold", "method", "path", "patient_id", "y_true", "y_pred")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _long(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One aggregation pass, then one row per rule."""
    wide = df.agg(*[c.alias(k) for k, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in checks])
    return wide.select(F.explode(pairs).alias("x")).select("x.rule", "x.violations")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def validate_predictions(preds: DataFrame) -> DataFrame:
    """(rule, violations) for a prediction table."""
    lost = missing_columns(preds, PREDICTION_COLUMNS)
    if lost:
        raise ValueError(f"missing prediction columns: {lost}")
    blank = lambda c: F.trim(F.col(c).cast("string")) == ""
    nonint = lambda c: F.col(c).cast("double") != F.floor(F.col(c).cast("double"))
    cells = _long(preds, {
        "missing_value": _count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in PREDICTION_COLUMNS])),
        "blank_identifier": _count_if(blank("patient_id") | blank("path") | blank("method")),
        "noninteger_code": _count_if(nonint("fold") | nonint("y_true") | nonint("y_pred")),
    })
    repeats = preds.groupBy("method", "path").count().agg(
        F.lit("repeated_method_path").alias("rule"), _count_if(F.col("count") > 1).alias("violations"))
    by_group = preds.groupBy("patient_id").agg(
        F.min("fold").alias("f0"), F.max("fold").alias("f1"), F.min("y_true").alias("y0"), F.max("y_true").alias("y1"))
    crossing = _long(by_group, {
        "group_crosses_folds": _count_if(F.col("f0") != F.col("f1")),
        "group_crosses_labels": _count_if(F.col("y0") != F.col("y1")),
    })
    owners = preds.groupBy("path").agg(
        (F.min("patient_id") != F.max("patient_id")).alias("two")).agg(
        F.lit("path_in_two_groups").alias("rule"), _count_if(F.col("two")).alias("violations"))
    # one row per class code
    codes = preds.groupBy("y_true").count().agg(
        F.min("y_true").alias("lo"), F.max("y_true").alias("hi"), F.count(F.lit(1)).alias("n"))
    code_rule = codes.select(
        F.lit("codes_not_dense").alias("rule"),
        F.when((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1), 0).otherwise(1).cast("bigint").alias("violations"))
    labels = preds.select(F.col("y_true").alias("y_pred")).distinct()
    unknown = preds.groupBy("y_pred").count().join(labels, "y_pred", "left_anti").agg(
        F.lit("unknown_predicted_label").alias("rule"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("violations"))
    return _union([cells, repeats, crossing, owners, code_rule, unknown])


def validate_posteriors(preds: DataFrame, k: int) -> DataFrame:
    v = valid_posterior(F.col("p"), F.col("y_pred"), k)
    return _long(preds, {name: _count_if(c) for name, c in v.items()})


def validate_manifest(manifest: DataFrame) -> DataFrame:
    """(rule, violations) for a manifest (path, label, split, grp)."""
    g = F.col("grp")
    no_group = g.isNull() | (F.trim(g) == "")
    cells = _long(manifest, {
        "missing_label": _count_if(F.col("label").isNull() | (F.trim("label") == "")),
        "missing_group": _count_if(no_group),
        "partial_groups": F.when((_count_if(no_group) > 0) & (_count_if(~no_group) > 0), 1).otherwise(0).cast("bigint"),
        "unknown_split": _count_if(F.col("split").isNull() | ~F.col("split").isin("train", "valid", "test")),
    })
    repeats = manifest.groupBy("path").count().agg(
        F.lit("repeated_path").alias("rule"), _count_if(F.col("count") > 1).alias("violations"))
    by_group = manifest.groupBy("grp").agg(
        F.min("split").alias("s0"), F.max("split").alias("s1"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    crossing = _long(by_group, {
        "group_crosses_splits": _count_if(F.col("s0") != F.col("s1")),
        "group_crosses_labels": _count_if(F.col("l0") != F.col("l1")),
    })
    # (split, label) pairs: three roles times the classes
    pairs = manifest.where(F.col("split").isin("train", "valid", "test")).select("split", "label").distinct()
    cover = pairs.agg(F.count_distinct("label").alias("k"), F.count(F.lit(1)).alias("n")).select(
        F.lit("class_missing_in_split").alias("rule"), (F.col("k") * 3 - F.col("n")).cast("bigint").alias("violations"))
    return _union([cells, repeats, crossing, cover])


def validate_outer_folds(folds: DataFrame) -> DataFrame:
    """(rule, violations) for rows (fold, grp, path, role): each group in one outer test
    fold exactly, and the same rows in every fold."""
    n_folds = folds.select("fold").distinct().agg(F.count(F.lit(1)).alias("n_folds"))
    per_group = folds.groupBy("grp").agg(
        F.count_distinct(F.when(F.col("role") == "test", F.col("fold"))).alias("t"))
    tested = _long(per_group, {
        "group_in_two_test_folds": _count_if(F.col("t") > 1),
        "group_never_tested": _count_if(F.col("t") == 0),
    })
    per_path = folds.groupBy("path").agg(F.count_distinct("fold").alias("f"), F.count(F.lit(1)).alias("n"))
    same = _long(per_path.join(F.broadcast(n_folds)), {
        "row_not_in_every_fold": _count_if(F.col("f") != F.col("n_folds")),
        "row_repeated_in_fold": _count_if(F.col("n") > F.col("f")),
    })
    cross = folds.groupBy("fold", "grp").agg((F.min("role") != F.max("role")).alias("x")).agg(
        F.lit("group_crosses_roles").alias("rule"), _count_if(F.col("x")).alias("violations"))
    return _union([tested, same, cross])


def require_clean(report: DataFrame) -> None:
    """Raise when any rule is broken. The report has a handful of rows."""
    bad = [(r["rule"], r["violations"]) for r in report.where("violations > 0").collect()]
    if bad:
        raise ValueError(f"validation failed: {sorted(bad)}")


def ledger_audit(events: DataFrame, max_reads: int = 1) -> DataFrame:
    """Per run: decisions before and after the freeze, decisions made on test rows, reads
    before the freeze, reads beyond the limit per purpose.

    ``events`` is (run, seq, kind in decision/freeze/read/note, split_used, purpose). The
    freeze positions, one row per run, are written first: their size is known when the join is
    planned, and a run holding a large part of all events can be split.
    """
    freeze = write_and_read(events.where("kind = 'freeze'").groupBy("run").agg(F.min("seq").alias("freeze_seq")), "freeze")
    tagged = events.where("kind in ('decision', 'read')").select("run", "kind", "split_used", "purpose", "seq").join(freeze, "run", "left")
    before = F.col("freeze_seq").isNull() | (F.col("seq") < F.col("freeze_seq"))
    dec, read = F.col("kind") == "decision", F.col("kind") == "read"
    n = F.lit(1)
    per_purpose = tagged.groupBy("run", "kind", "purpose").agg(
        F.sum(F.when(dec & before, n).otherwise(0)).alias("decisions_before_freeze"),
        F.sum(F.when(dec & ~before, n).otherwise(0)).alias("decisions_after_freeze"),
        F.sum(F.when(dec & (F.col("split_used") == "test"), n).otherwise(0)).alias("decisions_on_test"),
        F.sum(F.when(read & before, n).otherwise(0)).alias("reads_before_freeze"),
        F.sum(F.when(read, n).otherwise(0)).alias("reads"),
    )
    over = F.greatest(F.col("reads") - max_reads, F.lit(0))
    body = per_purpose.groupBy("run").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in (
            "decisions_before_freeze", "decisions_after_freeze", "decisions_on_test", "reads_before_freeze", "reads")],
        F.sum(over).cast("bigint").alias("reads_over_limit"),
        _count_if(F.col("reads") > 0).alias("purposes_read"),
    )
    return body.join(freeze.select("run", F.lit(True).alias("frozen")), "run", "left").withColumn(
        "frozen", F.coalesce("frozen", F.lit(False)))


def requested_vs_effective(binds: DataFrame) -> DataFrame:
    """Per role: requested and effective settings seen, whether uniform, and the notes.

    The settings and notes are few distinct values, so they are made distinct before the
    per-role lists are built.
    """
    def listed(col: str) -> DataFrame:
        return (binds.where(F.col(col).isNotNull()).select("role", F.col(col).cast("string").alias("v")).distinct()
                .groupBy("role").agg(F.array_join(F.array_sort(F.collect_list("v")), ";").alias(col)))
    flags = binds.groupBy("role").agg(
        F.count(F.lit(1)).alias("binds"),
        _count_if(F.col("requested") != F.col("effective")).alias("substituted"),
        (F.min("effective") == F.max("effective")).alias("uniform"))
    out = flags
    for c in ("requested", "effective", "note"):
        out = out.join(listed(c), "role", "left")
    return out


def substitutions(binds: DataFrame) -> DataFrame:
    """(role, backbone, requested, effective, note, binds) of the binds served at another setting than the requested one."""
    return binds.where(F.col("requested") != F.col("effective")).groupBy(
        "role", "backbone", "requested", "effective", "note").agg(F.count(F.lit(1)).alias("binds"))


def stamp_reportability(results: DataFrame, cohort: str, rules: DataFrame) -> DataFrame:
    """Adds reportable, reason and the share of the cohort seen elsewhere to every row.

    ``rules`` is a hand-kept table of a few rows (family, reportable, reason, shared_n,
    shared_of). A family without a rule is reportable, and its overlap stays blank: not
    measured is not the same as zero.
    """
    from assay.functions.text import cohort_family

    j = results.withColumn("family", cohort_family(F.col(cohort))).join(F.broadcast(rules), "family", "left")
    shared = F.when(F.col("shared_n").isNotNull(), F.concat_ws("/", "shared_n", "shared_of")).otherwise(F.lit(""))
    return (j.withColumn("reportable", F.coalesce("reportable", F.lit(True)))
            .withColumn("reason", F.coalesce("reason", F.lit(""))).withColumn("shared", shared).drop("shared_n", "shared_of"))
