"""Compares a query with its DuckDB SQL, without regard to row order."""

import duckdb
import numpy as np

TABLES = "documents embeddings pages benchmark labels conversations events lineitem orders".split()


def _plain(value):
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, float | np.floating):
        return round(float(value), 6)
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, (tuple(map(_plain, r)) for r in frame.astype(object).itertuples(index=False, name=None))))


def connect(folder):
    out = duckdb.connect()
    for name in TABLES:
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return out
