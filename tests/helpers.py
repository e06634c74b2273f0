"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def rows_of(frame) -> list[str]:
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if hasattr(x, "tolist") and not isinstance(x, str):
            x = x.tolist()
        if isinstance(x, float):
            return int(x) if x.is_integer() else round(x, 9)
        return x if not isinstance(x, list) else [cell(y) for y in x]

    names = sorted(frame.columns)
    return sorted(repr([cell(x) for x in row]) for row in frame[names].astype(object).itertuples(index=False))


def oracle(folder: Path, sql: str):
    con = duckdb.connect()
    for file in folder.iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con.execute(sql).df()


def check_against_sql(spark, query, sql: str, folder: Path) -> int:
    ours = query(spark, str(folder)).toPandas()
    theirs = oracle(folder, sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
    return len(ours)
