"""All registered queries. Importing a module of queries registers them."""

from __future__ import annotations

from assay.plans import (  # noqa: F401
    metric_queries,
    manifest_queries,
    resample_queries,
    dedup_queries,
    feature_queries,
)
from assay.plans.registry import ORACLE, QUERIES, with_ctes


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {name: with_ctes(sql, needs) for name, (sql, needs) in ORACLE.items()}
