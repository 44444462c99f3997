"""Rows of a query held against the rows of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def same_rows(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    assert got == want
