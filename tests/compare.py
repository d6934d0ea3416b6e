"""Rows of a query against rows of its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if value is None or pd.isna(value):
        return "null"
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}" if abs(value) < 1e12 else str(int(value))
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(x) for x in row) for row in frame[names].astype(object).values.tolist())
