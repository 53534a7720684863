"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.session import cut_lineage


def _pull(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the least neighbour m of u. Both sides are dealt anew, so that the
    rows of a hub with very many neighbours can be split."""
    return edges.join(cut_lineage(least), "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _pull(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    pulled = _pull(down, least)
    return (pulled.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(pulled.select("u", F.col("m").alias("v"))).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: every node but the smallest of its component, with that smallest node.

    ``edges`` has two columns of one orderable type, no loops and no nulls. The rounds end when the
    edges are stars around the smallest nodes; that takes about log2 of the longest path squared.
    """
    edges = cut_lineage(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        edges = cut_lineage(small_star(large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges
