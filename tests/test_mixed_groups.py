"""Texts that occur in two languages: groups with two labels, as in larger tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from assay.operators import splits as sp
from tests.oracle import TABLES, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """The smallest tables, where every 20th text occurs again twice in another language."""
    folder = tmp_path_factory.mktemp("mixed")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    other = F.when(F.col("lang") == "en", "de").otherwise("en")
    again = d.where("doc_id % 20 = 0").withColumn("lang", other).withColumn("doc_id", F.explode(F.array(F.col("doc_id") + 10**6, F.col("doc_id") + 2 * 10**6)))
    d.unionByName(again).write.parquet(str(folder / "documents.parquet"))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}'")
    return str(folder), con


@pytest.mark.parametrize("name", ["grouped_stratified_kfold", "validation_holdout_per_fold", "validate_outer_folds", "prepare_manifest", "carve_split"])
def test_query_matches_sql(spark, mixed, name):
    folder, con = mixed
    assert difference(queries()[name](spark, folder), con, oracle_sql()[name]) is None


def test_mixed_group_moves_whole(spark):
    rows = [(f"p{i}", "ab"[i % 2], "train", f"g{i // 2}") for i in range(40)]
    out = sp.carve_split(spark.createDataFrame(rows, "path string, label string, split string, grp string"), "test", 0.3)
    assert out.count() == 40 and out.groupBy("grp").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_mixed_group_is_an_error_by_default(spark):
    rows = spark.createDataFrame([("a", "g"), ("b", "g")], "label string, grp string")
    with pytest.raises(Exception, match="conflicting labels"):
        sp.group_labels(rows).collect()
    assert sp.group_labels(rows, strict=False).count() == 2
