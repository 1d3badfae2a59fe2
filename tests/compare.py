"""Run a registered query and its SQL side by side and compare rows, order-insensitively."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value):
    return "float" if isinstance(value, float) else type(value).__name__


def compare(df, con, sql: str, show: int = 3) -> str | None:
    """None when equal, else a short description of the difference."""
    names = sorted(df.columns)
    rows = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(sql)
    other = [d[0] for d in cur.description]
    if sorted(other) != names:
        return f"columns differ: {names} vs {sorted(other)}"
    at = [other.index(n) for n in names]
    expected = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    a, b = Counter(rows), Counter(expected)
    kinds = lambda rs, i: {kind(r[i]) for r in rs if r[i] is not None}
    for i, n in enumerate(names):
        ka, kb = kinds(rows, i), kinds(expected, i)
        if ka and kb and ka != kb:
            return f"types of {n} differ: {ka} vs {kb}"
    if a == b:
        return None
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return f"{len(rows)} vs {len(expected)} rows, {len(only_a)}/{len(only_b)} unmatched\n  {names}\n  spark {sorted(only_a, key=key)[:show]}\n  duck  {sorted(only_b, key=key)[:show]}"
