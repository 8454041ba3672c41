"""Compares registered queries with their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_sql(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.execute(sql).df()


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return f"{float(x):.6g}" if isinstance(x, float | int) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(x) for x in row) for row in df.astype(object).itertuples(index=False))
