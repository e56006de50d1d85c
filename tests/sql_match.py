"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> tuple[list[str], list[str]]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    columns = sorted(df.columns)
    return columns, sorted(str(tuple(plain(x) for x in row)) for row in df[columns].astype(object).itertuples(index=False, name=None))


def assert_same(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    assert rows_of(spark_df.toPandas()) == rows_of(con.sql(sql).df())
