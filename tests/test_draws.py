"""The bootstrap's draw matrix is bounded, and its size changes no draw."""

from pyspark.sql import functions as F

from assay.operators import resample as rs


def test_draws_at_once_change_nothing(spark, monkeypatch):
    g = spark.range(400).select((F.col("id") % 2).cast("int").alias("stratum"), F.concat(F.lit("g"), "id").alias("grp"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    got = []
    for draws in (1_000_000, 900):
        monkeypatch.setattr(rs, "DRAWS", draws)
        got.append(sorted((r.rep, tuple(r.v)) for r in rs.cluster_replicates(g, 120, 42).collect()))
    assert got[0] == got[1] and len(got[0]) == 120 and all(v[1] == 400 for _, v in got[0])


def test_blocks_are_not_merged_by_size(spark):
    """Blocks of few bytes stay in partitions of their own."""
    g = spark.range(400).select(F.lit(0).alias("stratum"), F.concat(F.lit("g"), "id").alias("grp"), F.array(F.lit(1.0)).alias("v"))
    plan = rs.cluster_replicates(g, 2000, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and rs.DRAWS <= 1_000_000
