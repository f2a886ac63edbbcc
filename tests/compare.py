"""Rows of a Spark query and of its SQL in a form that can be compared."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def database(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.6g}"
    return f"{float(v):.6g}" if hasattr(v, "as_tuple") else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))
