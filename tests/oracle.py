"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.date().isoformat() if x.time() == datetime.time() else x.isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir: str, run, sql: str) -> str:
    """What differs, or an empty string."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    kinds = {c.lower(): str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [(c, t, kinds[c.lower()]) for c, t in df.dtypes if same.get(t, t) != kinds[c.lower()]]
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else ""
