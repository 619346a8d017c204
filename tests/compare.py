"""Compare a query's rows with its SQL's on the same Parquet tables."""

import datetime
import decimal
import os

import duckdb


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, decimal.Decimal):
        return float(x)
    return 0.0 if isinstance(x, float) and x == 0 else x


def rows(t):
    cols = sorted(t.column_names)
    return cols, sorted(repr(tuple(map(plain, r))) for r in zip(*[t[c].to_pylist() for c in cols], strict=True))


def tables(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def same(df, con, sql):
    (cols, got), (other, want) = rows(df.toArrow()), rows(con.sql(sql).to_arrow_table())
    assert cols == other
    assert got == want
