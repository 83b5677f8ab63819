"""Runs registered queries and their SQL side by side."""

from __future__ import annotations

import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def checking_engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    engine = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return engine


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(row) for row in frame.itertuples(index=False)), key=repr)


def differences(spark, engine, name: str, function, sql: str, sf_dir: str) -> str | None:
    """None if both give the same columns, types of values and rows."""
    start = time.time()
    ours = function(spark, sf_dir).toPandas()
    took = time.time() - start
    theirs = engine.execute(sql).df()
    print(f"{name}: {len(ours)} rows, {took:.1f}s + {time.time() - start - took:.1f}s", flush=True)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    kinds = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours.columns}
    unlike = {c: k for c, k in kinds.items() if k[0] != k[1] and "str" not in k[1] and "object" not in k}
    if unlike:
        return f"types {unlike}"
    a, b = normal(ours), normal(theirs)
    if a != b:
        at = next(i for i in range(len(a)) if a[i] != b[i])
        return f"row {at}: {a[at]} != {b[at]}"
    return None
