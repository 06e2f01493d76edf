"""Compare registered queries with their SQL in DuckDB.

    python tests/compare.py <table folder> [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, float):
            return round(v, 9)
        return v.item() if hasattr(v, "item") else v

    names = sorted(frame.columns)
    cells = [[plain(v) for v in frame[n].astype(object)] for n in names]
    return sorted(zip(*cells), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = rows(ours), rows(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if tuple(map(str, x)) != tuple(map(str, y))]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


_KIND = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
         "BOOLEAN": "boolean"}


def type_differences(ours, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Columns whose type is not the same in both engines."""
    theirs = {n: t for n, t, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    return ", ".join(f"{n}: {t} / {theirs.get(n)}" for n, t in ours.dtypes
                     if _KIND.get(theirs.get(n, ""), "?") != t)


def main() -> None:
    from sessions import make_session
    from reviewlake.plans.queries import QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, bad = make_session(), connect(sf_dir), 0
    for name, q in QUERIES.items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            frame = q.run(spark, sf_dir)
            ours = frame.toPandas()
            took = time.time() - began
            problem = "no SQL" if q.sql is None else (
                differences(ours, con.execute(q.sql).fetchdf())
                or type_differences(frame, con, q.sql) or None)
        except Exception as e:
            took, problem, ours = 0, f"{type(e).__name__}: {str(e)[:1500]}", []
        bad += problem not in (None, "no SQL")
        print(f"{name:28} {len(ours):7} rows {took:6.2f}s {problem or 'equal'}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
