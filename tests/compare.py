"""Spark results against DuckDB's on the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((norm(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    if hasattr(v, "normalize") and hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    return rows_of(cols, got.fetchall())


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def difference(spark, name, query, sql, sf_dir):
    """None if both agree, else what differs."""
    a, b = spark_rows(query(spark, sf_dir)), duck(sql, sf_dir)
    if a[0] != b[0]:
        return f"{name}: columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{name}: rows {len(a[1])} != {len(b[1])}; spark {a[1][:2]} duck {b[1][:2]}"
    for x, y in zip(a[1], b[1], strict=True):
        if x != y:
            return f"{name}: {x} != {y}"
    return None
