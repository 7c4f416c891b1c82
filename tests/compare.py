"""Rows of a Spark result against those of the same SQL in DuckDB, whatever their order."""

import datetime
import decimal
import math
import os

import duckdb

from millrace.sources.tables import NAMES


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return value if isinstance(value, int) else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else int(value) if value.is_integer() and abs(value) < 2**53 else float(f"{value:.11g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sf_dir: str, sql: str) -> None:
    ours = canonical(df.columns, df.collect())
    theirs = canonical(*oracle(sf_dir, sql))
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
