"""Comparing a query with its SQL as sets of rows."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connection(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return v


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in row]) for row in frame.itertuples(index=False))


def assert_same(got: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
