"""Side-by-side check of a Spark query against its DuckDB oracle (tests and local runs)."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

from lintlake.sources.corpus import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    if os.path.exists(f"{sf_dir}/code_files.parquet"):
        con.execute(f"CREATE VIEW code_files AS SELECT * FROM read_parquet('{sf_dir}/code_files.parquet/*.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, sql: str, con) -> tuple[bool, str]:
    left = spark_df.toPandas()
    right = con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return False, f"columns differ: {sorted(left.columns)} vs {sorted(right.columns)}"
    a, b = rows_of(left), rows_of(right)
    if len(a) != len(b):
        return False, f"row counts differ: spark {len(a)} vs oracle {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first: spark {bad[0][0]} vs oracle {bad[0][1]}"
    return True, f"{len(a)} rows equal"
