"""Comparison of a Spark result with DuckDB's, as sorted rows of text."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value) -> str:
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.sql(sql)
    columns = sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    return columns, sorted(tuple(shown(r[i]) for i in at) for r in result.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
