"""Runs a registered query and its SQL on the same tables and compares them as sets of rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return "null"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(text, x)) + "]"
    if isinstance(x, (float, np.floating)):
        return "null" if math.isnan(x) else str(int(x)) if x == int(x) else f"{x:.9g}"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(tuple(map(text, r)) for r in frame[names].itertuples(index=False, name=None))


def expected(sql: str, data: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.sql(sql).df()


def agree(spark, query, sql: str, data: str = DATA) -> None:
    got, want = query(spark, data).toPandas(), expected(sql, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
