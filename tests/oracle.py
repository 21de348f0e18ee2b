"""Runs catalogue queries on Spark and their SQL on DuckDB over the same tables, and compares all rows."""

from __future__ import annotations

import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET threads=4; SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall(), [str(c[1]) for c in cur.description]


def compare(df, sf_dir: str, sql: str) -> str:
    """Empty if both have the same columns and rows, else what differs."""
    names, rows, kinds = sql_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    if mine == theirs:
        return ""
    a, b = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark: {a}; only SQL: {b}; types {dict(df.dtypes)} and {dict(zip(names, kinds))}"
