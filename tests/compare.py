"""Comparison of a query's rows with those of its SQL on DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import datetime

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x.isoformat() if isinstance(x, datetime) else x


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same_rows(df, sql: str, sf_dir: str = DATA) -> None:
    con = connect(sf_dir)
    rel = con.sql(sql)
    names, want = list(rel.columns), rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    got, want = bag(df.columns, [tuple(r) for r in df.collect()]), bag(names, want)
    assert got == want, f"only in Spark: {list((got - want).items())[:3]}; only in SQL: {list((want - got).items())[:3]}"
    assert got, "no rows"
