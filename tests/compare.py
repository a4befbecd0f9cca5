"""Run registered queries beside their SQL and compare schema, rows and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def _rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = spark_df.columns
    got = _rows(names, spark_df.collect())
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = _rows(want_names, cur.fetchall())
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    kinds = {(type(a).__name__, type(b).__name__) for g, w in zip(got, want) for a, b in zip(g, w) if a is not None and b is not None and type(a) is not type(b)}
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0][0]} != {bad[0][1]}"
    return f"types {kinds}" if kinds else None
