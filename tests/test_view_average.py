"""The mean over views has the value of SQL's sum over number, to the last digit."""

import numpy as np

from assay.operators import features as fe
from assay.plans.feature_queries import _long


def test_plain_sum_over_number(spark):
    """Of vectors longer and shorter than a part, one of them empty."""
    rng = np.random.default_rng(7)
    items = {f"v{n}": rng.normal(0, 0.125, (3, n)) for n in (0, 1, fe.VIEW_PART, 2 * fe.VIEW_PART + 6)}
    rows = [(p, v, [float(y) for y in x[v]]) for p, x in items.items() for v in range(3)]
    d = spark.createDataFrame(rows, "path string, v int, features array<double>").repartition(3, "path").sortWithinPartitions("path", "v")
    got = {r["path"]: r["features"] for r in fe.view_average(d, ["path"]).collect()}
    assert got == {p: ((0.0 + x[0] + x[1] + x[2]) / 3).tolist() for p, x in items.items()}


def test_billionth_that_a_running_mean_misses(spark):
    views = (-0.18119677901268005, -0.15307710111141204, 0.1792348176240921)
    d = spark.createDataFrame([("a", [x]) for x in views], "path string, features array<double>").coalesce(1)
    want = spark.sql("SELECT CAST(round(avg(x)*1e9) AS BIGINT) AS x FROM VALUES " + ",".join(f"({x!r}D)" for x in views) + " AS t(x)").first()["x"]
    assert _long(fe.view_average(d, ["path"]), ["path"]).first()["x"] == want == -51679687
