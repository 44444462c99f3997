"""Rows of a query held against the rows of its SQL in DuckDB."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def connect(sf=SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows_of_sql(sql, sf=SF):
    cur = connect(sf).execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)


def same_rows(spark, query, sql, sf=SF):
    names, want = rows_of_sql(sql, sf)
    df = query(spark, sf)
    assert sorted(df.columns) == names
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == want, [x for x in zip(got, want, strict=False) if x[0] != x[1]][:3]
    return len(got)
