"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "item"):
        return _norm(value.item())
    if isinstance(value, (list, tuple)):
        return [_norm(v) for v in value]
    return value if isinstance(value, (int, str)) else str(value)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_norm(r[i]) for i in order]) for r in data)


def compare(spark, con, sf_dir, fn, sql):
    """(problem or None, number of rows)."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(got)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return None, len(got)
    left, right = set(a) - set(b), set(b) - set(a)
    return (f"rows {len(a)} vs {len(b)}; only spark {sorted(left)[:3]}; only sql {sorted(right)[:3]}; "
            f"columns {sorted(names)}"), len(got)
