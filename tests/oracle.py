"""Holds a DataFrame against DuckDB SQL over the same Parquet tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

SMALL = "/root/testdata/sf0.001"


def plain(v):
    """A value in a form that both engines share; floats to nine digits."""
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def views(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


def assert_same(df: DataFrame, sql: str, sf_dir: str = SMALL) -> None:
    want = views(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
