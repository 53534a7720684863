"""String columns: split names, identifiers, class names, paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted names of the three roles.
SPLIT_ALIASES = {
    "train": "train", "training": "train",
    "valid": "valid", "val": "valid", "validation": "valid",
    "test": "test", "testing": "test",
}

# Names a "nothing found" class goes by; scanned in class order.
NORMAL_ALIASES_ANY = (
    "no_tumor", "notumor", "no_tumour", "notumour", "normal", "healthy",
    "no", "none", "negative", "non_tumor", "non_tumour",
)

# The same, in priority order.
NORMAL_ALIASES_RANKED = ("notumor", "no_tumor", "normal", "healthy", "nontumor", "no_tumor")

# Picture file endings.
IMAGE_PATTERN = r"\.(jpg|jpeg|png|bmp|webp|tif|tiff)$"


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalize_split(col: Column, strict: bool = True) -> Column:
    """train / valid / test; blank or null means train; an unknown name is an error."""
    key = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    known = F.try_element_at(literal_map(SPLIT_ALIASES), key)
    miss = (
        F.raise_error(F.concat(F.lit("unknown split name: "), col)).cast("string")
        if strict else F.lit(None).cast("string")
    )
    return F.when(key == "", F.lit("train")).otherwise(F.coalesce(known, miss))


def file_stem(path: Column) -> Column:
    base = F.substring_index(F.rtrim(F.translate(path, "\\", "/"), F.lit("/")), "/", -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def group_id_from_path(path: Column) -> Column:
    """File name stem up to the first ``__``; the stem where there is none."""
    return F.substring_index(file_stem(path), "__", 1)


def group_family(group_id: Column) -> Column:
    return F.regexp_replace(group_id, r"^(MR\d+)[A-Z]$", "$1")


def group_key(path: Column, unit: Column | str) -> Column:
    """Grouping key at unit image, identifier or family."""
    u = F.lit(unit) if isinstance(unit, str) else unit
    gid = group_id_from_path(path)
    return (
        F.when(u == "image", file_stem(path))
        .when(u == "identifier", gid)
        .when(u == "family", group_family(gid))
        .otherwise(F.raise_error(F.concat(F.lit("unknown grouping unit: "), u)).cast("string"))
    )


def safe_name(col: Column) -> Column:
    return F.regexp_replace(F.replace(col, F.lit("+"), F.lit("PLUS")), r"[^a-zA-Z0-9_.-]+", "_")


def normalize_class_name(col: Column) -> Column:
    return F.trim(F.translate(F.lower(col), "- ", "__"))


def relative_posix(path: Column, root: str) -> Column:
    """Path below ``root`` with forward slashes."""
    clean = F.translate(path, "\\", "/")
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(clean, F.lit(prefix)), F.substring(clean, len(prefix) + 1, 1 << 30)).otherwise(clean)


def cohort_family(key: Column) -> Column:
    """Family whose rules apply to a dataset variant."""
    k = F.lower(F.trim(key))
    return F.when(F.startswith(k, F.lit("pw")), "pw").when(F.startswith(k, F.lit("nick")), "nick").otherwise(k)


# Dataset family -> family that holds its feature table.
FEATURE_FAMILY = {"bal": "bal", "imb": "bal", "nick": "bal", "nick_dedup": "bal"}

# Short names of feature extractors.
EXTRACTOR_ALIASES = {
    "vit": "vit_b_16", "vitb16": "vit_b_16", "densenet": "densenet121", "d121": "densenet121",
    "d169": "densenet169", "resnext50_32x4d": "resnext50", "vgg_19": "vgg19",
    "inception_v1": "googlenet", "efficientnet": "efficientnet_b0", "effb0": "efficientnet_b0",
    "xrv": "xraytorchvision", "xrv_densenet": "xraytorchvision",
}


def feature_family(key: Column) -> Column:
    fam = cohort_family(key)
    table = literal_map(FEATURE_FAMILY)
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(key))), F.try_element_at(table, fam), fam)


def canonical_extractor(name: Column) -> Column:
    n = F.trim(F.lower(name))
    return F.coalesce(F.try_element_at(literal_map(EXTRACTOR_ALIASES), n), n)


def null_nonfinite(col: Column) -> Column:
    """NaN and both infinities become null."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(col) | (F.abs(col) == inf), F.lit(None)).otherwise(col)


def null_nonfinite_array(col: Column) -> Column:
    return F.transform(col, null_nonfinite)
