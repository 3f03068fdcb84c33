"""Compares a Spark result with DuckDB SQL over the same Parquet tables."""

import datetime
import decimal
import math

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return found


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return str(value.date())
    return f"{float(value):.6g}" if isinstance(value, int) and abs(value) < 100_000 else str(value)


def rows(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in data)


def assert_same(df, sql: str, sf_dir: str) -> None:
    with connect(sf_dir) as con:
        found = con.sql(sql)
        expected = rows(found.columns, found.fetchall())
        names = sorted(found.columns)
    assert sorted(df.columns) == names
    assert rows(df.columns, df.collect()) == expected
    assert expected, "the fixture gives no rows"
