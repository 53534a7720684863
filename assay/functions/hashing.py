"""Portable hashes: every random choice is md5(seed | purpose | key), so results do not
depend on partitioning and any SQL engine can reproduce them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def h32(col: Column) -> Column:
    """First 8 hex digits of md5 as a BIGINT in [0, 2**32)."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint")


def seeded(seed: int, purpose: str, *keys: Column) -> Column:
    """32 hex digits that order the keys randomly for one seed and purpose."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys]))


def content_sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def content_md5(col: Column) -> Column:
    return F.md5(col.cast("binary"))


def settings_digest(cols: dict[str, Column]) -> Column:
    """Identity of a settings record: sha256 of its JSON with the keys in sorted order."""
    fields = [cols[k].alias(k) for k in sorted(cols)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def rule_string(cols: dict[str, Column]) -> Column:
    """Readable identity of a settings record: k=v pairs in sorted order."""
    parts = [F.concat(F.lit(k + "="), F.coalesce(cols[k].cast("string"), F.lit(""))) for k in sorted(cols)]
    return F.concat_ws("|", *parts)
