"""Comparison of a Spark result with the rows DuckDB returns for its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return ("f", round(v, 6))
    if isinstance(v, (bool, int)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(table, names):
    return sorted((tuple(plain(r[i]) for i in names) for r in table), key=str)


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def same(df, sf_dir: str, sql: str) -> None:
    names, expected = oracle(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    found = df.select(*names).collect()
    assert rows(found, range(len(names))) == rows(expected, range(len(names)))
