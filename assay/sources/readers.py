"""Readers for manifests, predictions, features and result files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assay.functions.text import IMAGE_PATTERN, normalize_split
from assay.operators.manifests import manifest_digest

PREDICTION_TYPES = {"fold": "int", "method": "string", "path": "string", "patient_id": "string",
                    "y_true": "int", "y_pred": "int"}


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV with a header; reads no data beyond the first rows."""
    names = spark.read.csv(path, header=True).columns
    return [n.lstrip("\ufeff").strip() for n in names]


def read_csv_typed(spark: SparkSession, path: str, types: dict[str, str], optional_prefix: str = "") -> DataFrame:
    """CSV by header name: wanted columns get their type, others starting with the optional
    prefix become doubles, the rest stay strings. No schema inference pass."""
    header = csv_header(spark, path)
    fields = [f"`{h}` " + (types.get(h) or ("double" if optional_prefix and h.startswith(optional_prefix) else "string"))
              for h in header]
    return spark.read.csv(path, header=True, schema=", ".join(fields), enforceSchema=True)


def scan_manifest_csv(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Manifest CSV -> (path, label, split, grp): labels trimmed, a blank group is null, relative
    paths resolved below ``root``, split names normalised. A blank label is an error."""
    d = read_csv_typed(spark, path, {})
    lost = {"path", "label"} - set(d.columns)
    if lost:
        raise ValueError(f"manifest CSV needs path and label; missing {sorted(lost)}")
    p = F.translate("path", "\\", "/")
    full = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    label = F.trim(F.coalesce("label", F.lit("")))
    stop = F.raise_error(F.concat(F.lit("blank label for "), F.col("path"))).cast("string")
    group = F.nullif(F.trim(F.col("group")), F.lit("")) if "group" in d.columns else F.lit(None).cast("string")
    split = F.col("split") if "split" in d.columns else F.lit("")
    return d.select(full.alias("path"), F.when(label == "", stop).otherwise(label).alias("label"),
                    normalize_split(split).alias("split"), group.alias("grp"))


def scan_class_folders(spark: SparkSession, root: str, pattern: str = IMAGE_PATTERN) -> DataFrame:
    """Folder tree root/[split/]class/... -> (path, label, split, length). Hidden folders are
    skipped. File content is never read: only path and length are selected.

    A first folder that names a role is the split; without role folders everything is train.
    Two folders for one role are an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    # file paths are complete URIs: what follows the root's own path below its scheme and host
    below = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    below = below if below.startswith("/") else "/" + below
    rel = F.substr("path", F.locate(below, F.col("path")) + len(below))
    d = files.where(F.lower("path").rlike(pattern)).withColumn("rel", rel).where(~F.col("rel").rlike(r"(^|/)\."))
    part = lambda i: F.regexp_replace(F.get(F.split("rel", "/"), F.lit(i)), "^[^=]*=", "")
    role = normalize_split(part(0), strict=False)
    d = d.select("path", "length", role.alias("role"), part(0).alias("first"), part(1).alias("second"))
    twice = d.where("role is not null").groupBy("role").agg(F.count_distinct("first").alias("n")).where("n > 1")
    if twice.limit(1).count():
        raise ValueError("several folders for one split; use a CSV manifest")
    return d.select("path", F.when(F.col("role").isNotNull(), F.col("second")).otherwise(F.col("first")).alias("label"),
                    F.coalesce("role", F.lit("train")).alias("split"), "length")


def scan_manifest_documents(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Manifest documents (one JSON object per part, parallel arrays inside) -> rows.

    Each part carries its first position and a digest of its rows; a part whose rows no
    longer give that digest is an error.
    """
    docs = spark.read.schema(
        "role string, first_pos bigint, files array<string>, labels array<string>, groups array<string>, digest string"
    ).json(path)
    rows = docs.select("role", "first_pos", "digest", F.posexplode(F.arrays_zip("files", "labels", "groups")).alias("i", "r")).select(
        "role", "first_pos", (F.col("first_pos") + F.col("i")).alias("pos"), F.col("r.files").alias("path"),
        F.col("r.labels").alias("label"), F.col("r.groups").alias("grp"), "digest")
    if not verify:
        return rows.drop("digest", "first_pos")
    now = manifest_digest(rows, ["role", "first_pos"]).withColumnRenamed("digest", "now")
    stop = F.raise_error(F.concat(F.lit("manifest part changed: "), F.col("role"))).cast("string")
    return rows.join(now, ["role", "first_pos"]).withColumn(
        "path", F.when(F.col("digest") == F.col("now"), F.col("path")).otherwise(stop)).drop("digest", "now", "first_pos")


ROLE_DOCUMENT = ("struct<bed: string, role: string, root: string, class_names: array<string>, files: array<string>, labels: array<int>, "
                 "source_bed: string, source_splits: array<string>, source_rows: array<bigint>, group_unit: string, groups: array<string>, digest: string>")
DOCUMENT = f"bed string, root string, class_names array<string>, group_unit string, seed bigint, built_at string, builder string, splits map<string, {ROLE_DOCUMENT}>"


def document_digest(files: Column, labels: Column) -> Column:
    """md5 over ``path NUL label newline`` of the entries in order, with forward slashes in paths."""
    entry = lambda r: F.concat(F.regexp_replace(F.coalesce(r["f"], F.lit("")), r"\\\\", "/"), F.lit("\x00"),
                               F.coalesce(r["y"].cast("string"), F.lit("")), F.lit("\n"))
    return F.md5(F.array_join(F.transform(F.arrays_zip(files.alias("f"), labels.alias("y")), entry), ""))


def scan_manifest_digests(spark: SparkSession, path: str) -> DataFrame:
    """(bed, role, entries, recorded, recomputed) of whole manifest documents, computed over each role's arrays where they
    are read; ``recorded`` is null where a document keeps no digest."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return docs.select("bed", F.explode("splits").alias("role", "s")).select(
        "bed", "role", F.size("s.files").alias("entries"), F.col("s.digest").alias("recorded"),
        document_digest(F.col("s.files"), F.col("s.labels")).alias("recomputed"))


def scan_whole_manifest(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Whole manifest documents (one JSON object per file, pretty-printed or not, each role with its
    parallel arrays) -> a row per file entry: the header's bed, root, group unit, seed and builder, the
    role, its position, path, label index and name, group, and the split and row it came from.

    Arrays of unequal length and labels outside the class names are errors, and so is, unless ``verify`` is off, a role
    whose recorded digest isn't that of its entries; a role without a digest is taken as it is.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    head = ["bed", "root", "group_unit", "seed", "built_at", "builder"]
    each = docs.select(*head, F.explode("splits").alias("role", "s"))
    n = F.size("s.files")
    uneven = F.lit(False)
    for c in ("labels", "source_splits", "source_rows", "groups"):
        uneven = uneven | (F.size(f"s.{c}") != n)
    stop = F.raise_error(F.concat(F.lit("arrays of unequal length: "), F.col("role"))).cast("string")
    changed = F.lit(verify) & (F.col("s.digest") != document_digest(F.col("s.files"), F.col("s.labels")))
    edited = F.raise_error(F.concat(F.lit("manifest digest mismatch: "), F.col("bed"), F.lit("/"), F.col("role"))).cast("string")
    rows = each.withColumn("role", F.when(uneven, stop).when(changed, edited).otherwise(F.col("role"))).select(
        *head, "role", F.col("s.source_bed").alias("source_bed"), F.col("s.class_names").alias("names"), F.col("s.digest").alias("recorded_digest"),
        F.posexplode(F.arrays_zip(*[F.col(f"s.{c}").alias(c) for c in ("files", "labels", "groups", "source_splits", "source_rows")])).alias("pos", "r"))
    off = F.raise_error(F.concat(F.lit("label outside the classes: "), F.col("r.files"))).cast("string")
    return rows.select(
        *head, "role", F.col("pos").cast("bigint").alias("pos"), F.col("r.files").alias("path"), F.col("r.labels").alias("y"),
        F.coalesce(F.get("names", F.col("r.labels")), off).alias("label"), F.col("r.groups").alias("grp"), "source_bed",
        F.col("r.source_splits").alias("source_split"), F.col("r.source_rows").alias("source_row"), "recorded_digest")


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction CSV: ids as strings, ``p_*`` columns optional and gathered into ``p``."""
    d = read_csv_typed(spark, path, PREDICTION_TYPES, "p_")
    probs = sorted((c for c in d.columns if c.startswith("p_")), key=lambda c: int(c[2:]))
    if not probs:
        return d
    if probs != [f"p_{i}" for i in range(len(probs))]:
        raise ValueError("incomplete probability columns")
    return d.select(*[c for c in d.columns if c not in probs], F.array(*probs).alias("p"))


def scan_feature_table(spark: SparkSession, path: str, backbone: str, role: str, dim: int | None = None,
                       digest: str | None = None) -> DataFrame:
    """One block and role of a feature table; the partition filters prune the folders.

    A vector of another length or with a non-finite value is an error.
    """
    d = spark.read.parquet(path).where((F.col("backbone") == backbone) & (F.col("role") == role))
    if digest is not None:
        d = d.where(F.col("digest") == digest)
    bad = F.exists("features", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    if dim is not None:
        bad = bad | (F.size("features") != dim)
    stop = F.raise_error(F.concat(F.lit("invalid feature row: "), F.col("path"))).cast("array<float>")
    return d.withColumn("features", F.when(bad, stop).otherwise(F.col("features")))


def scan_result_files(spark: SparkSession, root: str, name: str = "selection_grid.csv") -> DataFrame:
    """All result CSVs called ``name`` below a root (single files or Spark output folders of that
    name): source file, row number within the file, spec, learner and the recorded seconds.

    Every distinct header is read on its own; columns that a file lacks are null. Only files of
    that name are listed. They are small, so a file is one row until its lines are cut.
    """
    base = root.rstrip("/")
    seen = [_csv_below(spark, base, {"pathGlobFilter": name}), _csv_below(spark, f"{base}/**/{name}", {"pathGlobFilter": "*.csv"})]
    lines = [d for d in seen if d is not None]
    if not lines:
        raise ValueError(f"no {name} below {root}")
    line = lines[0] if len(lines) == 1 else lines[0].union(lines[1]).distinct()
    first = line.where("row = 0")
    headers = [r[0] for r in first.select("value").distinct().collect()]  # one for each layout
    out = None
    for h in headers:
        names = [c.lstrip("\ufeff").strip().strip('"') for c in h.split(",")]
        mine = line.join(first.where(F.col("value") == h).select("source"), "source", "left_semi").where("row > 0")
        parsed = mine.select("source", "row", F.from_csv("value", ", ".join(f"`{c}` string" for c in names)).alias("r"))
        cell = lambda c: F.col(f"r.`{c}`") if c in names else F.lit(None).cast("string")
        part = parsed.select("source", F.col("row").alias("source_row"), cell("spec").alias("spec"), cell("learner").alias("learner"),
                             cell("fit_seconds").cast("double").alias("recorded_fit_seconds"))
        out = part if out is None else out.unionByName(part)
    return out


def _csv_below(spark: SparkSession, root: str, options: dict[str, str]) -> DataFrame | None:
    """(source, row, value): the lines of the matching files; None without any."""
    try:
        text = spark.read.format("text").options(recursiveFileLookup="true", wholetext="true", **options).load(root)
        if text.isEmpty():
            return None
    except AnalysisException:
        return None
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: x != "")
    return text.select(F.col("_metadata.file_path").alias("source"), F.posexplode(lines).alias("row", "value"))
