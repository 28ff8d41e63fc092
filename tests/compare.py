"""Spark results against DuckDB's, as unordered rows with rounded floats."""

from __future__ import annotations

import glob
import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(rows) -> list[tuple]:
    def one(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return tuple(map(one, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


def spark_rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    return plain(df.select(*cols).collect())


def sql_rows(con, sql: str, cols: list[str]) -> list[tuple]:
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(cols)
    return plain(con.sql(f"SELECT {', '.join(sorted(cols))} FROM ({sql})").fetchall())
