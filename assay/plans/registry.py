"""Registered queries: name -> callable(spark, sf_dir), with the oracle SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, tuple[str, tuple[str, ...]]] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, text: str, *deps: str) -> None:
    """A named piece of oracle SQL and the pieces it reads."""
    _CTES[name] = (text, deps)


def with_ctes(body: str, names: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    recursive = "RECURSIVE " if any("RECURSIVE_STEP" in _CTES[n][0] for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order) + "\n" + body


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a Spark query and, where SQL can say it, its oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = (sql, needs)
        return fn
    return deco


def H(expr: str) -> str:
    """SQL text of the portable 32-bit hash."""
    return f"('0x'||substr(md5({expr}),1,8))::BIGINT"


def NA(expr: str) -> str:
    """SQL text of a value in whole billionths."""
    return f"CAST(round(({expr})*1e9) AS BIGINT)"
