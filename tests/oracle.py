"""Comparison of a Spark query with its DuckDB form on the driver tables."""

import datetime
import decimal
import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return int(x) if x == int(x) and abs(x) < 1e15 else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, con) -> str:
    """An empty string, or what differs."""
    out = con.execute(sql)
    want = rows_of([d[0] for d in out.description], out.fetchall())
    got = rows_of(df.columns, df.collect())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""
