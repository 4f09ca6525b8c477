"""Row-for-row comparison of a Spark result with DuckDB's."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, list | tuple | np.ndarray):
        return "[" + ", ".join(plain(y) for y in x) + "]"
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float | np.floating) and np.isnan(x)):
        return "null"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, int | np.integer):
        return str(int(x))
    if isinstance(x, float | np.floating):
        return f"{x:.9g}"
    return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))
