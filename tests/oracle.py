"""Runs a query and its SQL and compares rows without regard to order."""

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def same(df, c, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[x]) for x in cols) for r in df.collect())
    rel = c.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want
    return len(got)
