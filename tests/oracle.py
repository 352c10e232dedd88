"""Comparison of a query with its SQL on DuckDB."""

import os

import duckdb


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(int(value)))
    if isinstance(value, float):
        return (1, repr(round(value, 9) + 0.0))
    return (1, str(value))


def connection(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return c


def same(df, c, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{x}`" for x in columns]).collect())
    names = ", ".join(f'"{x}"' for x in columns)
    want = sorted(tuple(map(plain, r)) for r in c.sql(f"SELECT {names} FROM ({sql})").fetchall())
    assert sorted(c.sql(sql).columns) == columns
    assert got == want
