"""Names of rows: ids as whole numbers in their order, texts as digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.session import write_and_read


def digest(text: Column | str) -> Column:
    """128 bits that stand for a text; null is told apart from empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.concat(F.when(text.isNull(), F.lit(b"\0")).otherwise(F.lit(b"\1")), F.coalesce(text.cast("binary"), F.lit(b"")))))


def ordered(docs: DataFrame, doc_id: str, missing: int) -> DataFrame:
    """``docs`` with ``d`` (long): numbers in the order of the ids, ``missing`` for null ones.

    Whole-number ids are their own numbers. Others (texts, dates, decimals) are numbered by a range sort of the distinct
    ids, so no task sees more than its range. A whole-number id equal to ``missing`` isn't told from a null one in order.
    """
    kind, name = docs.schema[doc_id].dataType, F.col(f"`{doc_id}`")
    if isinstance(kind, T.IntegralType):
        return docs.withColumn("d", F.coalesce(name.cast("long"), F.lit(missing)))
    ids = docs.select(name.alias("_id")).where("_id IS NOT NULL").distinct().repartitionByRange("_id").sortWithinPartitions("_id")
    ids = write_and_read(ids.withColumn("_d", F.monotonically_increasing_id()), "row-numbers")
    return docs.join(ids, name == F.col("_id"), "left").withColumn("d", F.coalesce("_d", F.lit(missing))).drop("_id", "_d")
