"""Writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def export_error_cases(preds: DataFrame, normal_idx: int | None) -> DataFrame:
    """Text lines: misclassified rows, then non-normal rows called normal."""
    def line(d: DataFrame, *head) -> DataFrame:
        return d.select(F.concat_ws("\t", *head, F.concat(F.lit("TRUE="), "y_true"), F.concat(F.lit("PRED="), "y_pred"),
                                    "method", "path").alias("line"))
    out = line(preds.where("y_true <> y_pred"))
    if normal_idx is not None:
        out = out.unionByName(line(preds.where((F.col("y_true") != normal_idx) & (F.col("y_pred") == normal_idx)), F.lit("MISSED")))
    return out


def flatten_for_csv(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Lists joined by ``;``, structs and maps as JSON, bulky columns dropped."""
    cols = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        kind = f.dataType.typeName()
        if kind == "array":
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), ";").alias(f.name))
        elif kind in ("map", "struct"):
            cols.append(F.to_json(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_ragged_csv(parts: list[DataFrame], path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Write rows with different columns under the union header; returns what was written."""
    flat = [flatten_for_csv(p, drop) for p in parts]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)
    write_new(out, path, "csv", header=True)
    return out


def write_new(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write to a target that must not exist; the job commit makes it all or nothing."""
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)


def write_manifest_documents(manifest: DataFrame, path: str, part_rows: int = 1000) -> None:
    """Manifest (split, pos, path, label, grp) as JSON documents of at most ``part_rows`` rows."""
    from assay.operators.manifests import manifest_digest

    d = manifest.select(F.col("split").alias("role"), (F.floor(F.col("pos") / part_rows) * part_rows).alias("first_pos"),
                        "pos", "path", "label", "grp")
    rows = F.array_sort(F.collect_list(F.struct("pos", "path", "label", "grp")))  # at most part_rows
    docs = d.groupBy("role", "first_pos").agg(rows.alias("r"))
    dig = manifest_digest(d, ["role", "first_pos"])
    out = docs.join(dig, ["role", "first_pos"]).select(
        "role", "first_pos", F.col("r.path").alias("files"), F.col("r.label").alias("labels"),
        F.col("r.grp").alias("groups"), "digest")
    write_new(out, path, "json")


def write_whole_manifests(manifest: DataFrame, path: str, root: str, group_unit: str, seed: int, builder: str) -> None:
    """Manifest (bed, role, pos, path, label, grp, source_bed, source_split, source_row) as whole documents, a folder and file
    for each bed, with the digest of every role.

    The format keeps a bed in one JSON object, so a task holds a bed's rows; beds are dealt over tasks. The class names are
    the bed's labels in order.
    """
    from assay.sources.readers import document_digest

    names = manifest.groupBy("bed").agg(F.array_sort(F.collect_set("label")).alias("class_names"))
    rows = manifest.join(names, "bed").withColumn("y", (F.array_position("class_names", F.col("label")) - 1).cast("int"))
    entry = F.struct("pos", "path", "y", "grp", "source_split", "source_row")
    roles = rows.groupBy("bed", "class_names", "role").agg(F.array_sort(F.collect_list(entry)).alias("r"), F.first("source_bed").alias("source_bed"))
    body = F.struct(
        "bed", "role", F.lit(root).alias("root"), "class_names", F.col("r.path").alias("files"), F.col("r.y").alias("labels"), "source_bed",
        F.col("r.source_split").alias("source_splits"), F.col("r.source_row").alias("source_rows"), F.lit(group_unit).alias("group_unit"),
        F.col("r.grp").alias("groups"), document_digest(F.col("r.path"), F.col("r.y")).alias("digest"))
    docs = roles.groupBy("bed", "class_names").agg(F.map_from_entries(F.collect_list(F.struct("role", body))).alias("splits"))
    out = docs.select(F.col("bed").alias("document"), "bed", F.lit(root).alias("root"), "class_names", F.lit(group_unit).alias("group_unit"),
                      F.lit(seed).cast("bigint").alias("seed"), F.lit(builder).alias("builder"), "splits")
    out.write.mode("errorifexists").partitionBy("document").json(path)


def write_feature_table(features: DataFrame, path: str, digest: DataFrame, rule_id: str) -> None:
    """Features (path, backbone, role, y, features) stored by block, role and a digest of the
    manifest and the preparation rule, so a changed manifest never meets an old table.

    ``digest`` is (role, digest), one row per role.
    """
    key = F.md5(F.concat_ws("|", "digest", "backbone", F.lit(rule_id)))
    d = features.join(F.broadcast(digest), "role").withColumn("digest", key)
    d.write.mode("errorifexists").partitionBy("backbone", "role", "digest").parquet(path)


def run_record(manifest: DataFrame, digests: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One row per run: settings, and per role the rows, groups, class counts and digest."""
    per_class = manifest.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    classes = per_class.groupBy("split").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("class_counts"))
    groups = manifest.groupBy("split").agg(F.count_distinct("grp").alias("n_groups"))
    roles = classes.join(groups, "split").join(digests, "split")
    # one entry per role; maps have no order, so the roles are sorted by name
    body = F.array_sort(
        F.collect_list(F.struct("split", "n", "n_groups", "class_counts", "digest")),
        lambda a, b: F.when(a["split"] < b["split"], -1).when(a["split"] > b["split"], 1).otherwise(0))
    conf = F.create_map(*[F.lit(x) for k in sorted(settings) for x in (k, settings[k])])
    return roles.agg(body.alias("splits")).select(conf.alias("settings"), "splits")
