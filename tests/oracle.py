"""Run a query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def compare(spark, connection, name, query, sql, sf_dir) -> None:
    got = query(spark, sf_dir)
    want = connection.sql(sql)
    want_columns = want.columns
    assert sorted(got.columns) == sorted(want_columns), (name, got.columns, want_columns)
    got_rows = sorted(
        (tuple(row[c] for c in sorted(got.columns)) for row in got.collect()), key=repr
    )
    order = [want_columns.index(c) for c in sorted(want_columns)]
    want_rows = sorted((tuple(row[i] for i in order) for row in want.fetchall()), key=repr)
    assert len(got_rows) == len(want_rows), (name, len(got_rows), len(want_rows))
    for g, w in zip(got_rows, want_rows, strict=True):
        assert g == w, f"{name}:\n spark  {g}\n duckdb {w}"
