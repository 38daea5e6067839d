"""Side-by-side check of a Spark result against DuckDB oracle SQL.

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows once each row is normalised (floats to 6 significant
decimals, None/NaN unified).
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_CONS: dict[str, duckdb.DuckDBPyConnection] = {}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = _CONS.get(sf_dir)
    if con is None:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        _CONS[sf_dir] = con
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return str(v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    out.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return out


def compare(spark_df, sql: str, sf_dir: str, show: int = 5) -> tuple[bool, str]:
    left = spark_df.toPandas()
    right = duck(sf_dir).sql(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return False, f"columns differ: {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return False, f"row count {len(left)} vs {len(right)}"
    a, b = rows_of(left), rows_of(right)
    if a == b:
        return True, f"{len(a)} rows equal"
    diffs = [(x, y) for x, y in zip(a, b) if x != y]
    cols = sorted(left.columns)
    msg = [f"{len(diffs)} differing rows of {len(a)}"]
    for x, y in diffs[:show]:
        cells = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        msg.append(str(cells))
    return False, "\n".join(msg)
