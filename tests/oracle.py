"""Compare a registered query with its SQL oracle the way an order-insensitive check does."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_cell(x) for x in v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_cell(r[i]) for i in idx) for r in rel.fetchall()), key=repr)


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    c1, r1 = rows_of_spark(df)
    c2, r2 = rows_of_sql(con, sql)
    if c1 != c2:
        return f"columns differ: spark {c1} sql {c2}"
    if len(r1) != len(r2):
        return f"row counts differ: spark {len(r1)} sql {len(r2)}"
    if not r1:
        return "both empty"
    for a, b in zip(r1, r2):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"rows differ: spark {a} sql {b} ({c1})"
    return None
