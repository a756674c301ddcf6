"""Spark results against SQL in DuckDB over the same tables."""

import glob
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def text(v) -> str:
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return repr(v)


def rows(columns, values) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(text(r[i]) for i in order) for r in values)


def compare(con, spark, sf, query, sql) -> None:
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, res.fetchall())
