"""Row numbers and running values over key groups of any size.

A plain window sorts a whole key group in one task, which fails when one label or run holds
a third of the table. Here the order is cut into buckets, each bucket is ranked on its own,
and per-bucket totals give the offset. The bucket tables are small: keys x buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.session import write_and_read

HASH_BUCKET_DIGITS = 3  # 4096 buckets per key group


def hash_rank(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str = "rank") -> DataFrame:
    """1-based rank within ``keys`` in the order of a hex hash column, then ``ties``.

    The hash is uniform, so its leading digits cut every key group into even buckets.
    """
    d = df.withColumn("_b", F.substring(order, 1, HASH_BUCKET_DIGITS))
    return _bucket_rank(d, keys, order, ties, out)


def ordered_rank(df: DataFrame, keys: list[str], order: str, out: str = "rank") -> DataFrame:
    """1-based rank within ``keys`` by a unique string column.

    The rows are dealt by ranges of (keys, order) and written once with the number of their range,
    so that the counts and the ranks see the same ranges, also when a task is retried.
    """
    ranged = df.repartitionByRange(*keys, order).withColumn("_b", F.spark_partition_id())
    return _bucket_rank(write_and_read(ranged, "ranges"), keys, order, [], out)


def block_rank(df: DataFrame, keys: list[str], order: str, width: int, out: str = "rank") -> DataFrame:
    """1-based rank within ``keys`` by a unique number, bucketed by ``order div width``."""
    return _bucket_rank(df.withColumn("_b", F.floor(F.col(order) / width)), keys, order, [], out)


def _bucket_rank(d: DataFrame, keys: list[str], order: str, ties: list[str], out: str) -> DataFrame:
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order, *ties)
    ranked = d.withColumn("_r", F.row_number().over(inside))
    return ranked.join(offsets, [*keys, "_b"]).withColumn(out, F.col("_r") + F.col("_off")).drop("_r", "_off", "_b")


def running_sum(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum within ``keys`` in the order of a hex hash column."""
    d = df.withColumn("_b", F.substring(order, 1, HASH_BUCKET_DIGITS))
    sums = d.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn("_c", F.sum(value).over(inside)).join(offsets, [*keys, "_b"])
            .withColumn(out, F.col("_c") + F.col("_off")).drop("_b", "_c", "_off"))


def running_max(df: DataFrame, keys: list[str], order: str, width: int, value: str, out: str,
                inclusive: bool = True) -> DataFrame:
    """Running maximum within ``keys`` by a unique number, bucketed by ``order div width``."""
    d = df.withColumn("_b", F.floor(F.col(order) / width))
    tops = d.groupBy(*keys, "_b").agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_b", F.max("_m").over(before).alias("_carry"))
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    return (d.withColumn("_in", F.max(value).over(inside)).join(carried, [*keys, "_b"])
            .withColumn(out, F.greatest("_in", "_carry")).drop("_b", "_in", "_carry"))


def class_sizes(df: DataFrame, keys: list[str], out: str = "size") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def holdout_count(size: Column, fraction: Column | float, keep_one: bool = True) -> Column:
    """Half-even rounded share of ``size``: at least 1 and, with ``keep_one``, at most size - 1."""
    f = F.lit(float(fraction)) if isinstance(fraction, (int, float)) else fraction
    n = F.bround(size * f, 0).cast("bigint")
    if keep_one:
        n = F.least(size - 1, n)
    return F.greatest(F.lit(1).cast("bigint"), n)
