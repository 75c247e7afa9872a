"""Runs a query and its SQL and compares rows without order."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (decimal.Decimal, int)):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    want = Counter(tuple(plain(r[k]) for k in order) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; {list((got - want).items())[:2]} and {list((want - got).items())[:2]}"
