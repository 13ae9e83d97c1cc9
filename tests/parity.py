"""Compare a query's rows with those of its SQL in DuckDB, order apart."""

from __future__ import annotations

import os

import duckdb

from basinflow.sources.tables import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def oracle_rows(sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    out = con.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
    return sorted(out.columns), sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=repr)


def check(spark, query, sql: str) -> None:
    df = query(spark, DATA)
    names, want = oracle_rows(sql)
    assert sorted(df.columns) == names
    assert rows(df) == want
