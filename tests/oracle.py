"""Runs a query and its SQL and compares rows."""

import os

import duckdb


def views(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name[:-8]} as select * from '{folder}/{name}'")
    return con


def rows(df) -> list:
    def text(v):
        if v is None or v != v:
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return [list(df.columns), *sorted([text(v) for v in r] for r in df.itertuples(index=False))]


def same(spark, run, sql: str, folder: str) -> None:
    got, want = rows(run(spark, folder).toPandas()), rows(views(folder).sql(sql).df())
    assert got == want
