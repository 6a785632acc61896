"""Spark-vs-DuckDB comparison used by the tests (order-insensitive multisets)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def spark_rows(df):
    names = df.columns
    return names, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    return names, rel.fetchall()


def compare(df, con, sql, limit_diff: int = 5):
    sn, sr = spark_rows(df)
    dn, dr = duck_rows(con, sql)
    problems = []
    if sorted(sn) != sorted(dn):
        problems.append(f"columns differ: spark={sorted(sn)} duck={sorted(dn)}")
        return problems
    if len(sr) != len(dr):
        problems.append(f"row count spark={len(sr)} duck={len(dr)}")
    a, b = _rows(sn, sr), _rows(dn, dr)
    if a != b:
        sa, sb = set(a), set(b)
        only_s = [r for r in a if r not in sb][:limit_diff]
        only_d = [r for r in b if r not in sa][:limit_diff]
        problems.append(f"values differ; cols={sorted(sn)}\n spark-only={only_s}\n duck-only={only_d}")
    return problems
