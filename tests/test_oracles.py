"""Every registered query with a SQL oracle, on the smallest tables, and the driver contract."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from assay.plans import catalog
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
SQLS = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_sql(spark, con, name):
    msg = difference(queries()[name](spark, SF), con, SQLS[name])
    assert msg in (None, "both empty")


def test_entry(spark):
    assert entry(spark).count() == 3


def test_names():
    assert set(oracle_sql()) <= set(queries())
    assert set(SQLS) <= set(oracle_sql()) and set(catalog.queries()) <= set(queries())
