"""Compare a registered query with its DuckDB SQL, columns by name and rows in any order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1).copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == bool:
            df[c] = df[c].astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: "None" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
        else:
            df[c] = df[c].astype(float) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = plain(got), plain(want)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            np.testing.assert_allclose(a[c].to_numpy(), b[c].to_numpy(), rtol=1e-9, atol=1e-12, err_msg=c)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
