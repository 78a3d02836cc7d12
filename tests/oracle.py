"""Run a registered query and its SQL twin and compare the rows exactly."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def cell(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return tuple(cell(v) for v in x)
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if isinstance(x, (int, float)) or hasattr(x, "item"):
            value = float(x)
            return 0.0 if value == 0 else value
        return str(x)

    rows = [tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, sf_dir: str, name: str, run, sql: str | None) -> tuple[str, float, int]:
    """('match' | 'rows' | difference, seconds, rows)."""
    start = time.perf_counter()
    got = run(spark, sf_dir).toPandas()
    seconds = time.perf_counter() - start
    if sql is None:
        return "rows", seconds, len(got)
    want = connect(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", seconds, len(got)
    a, b = canonical(got), canonical(want)
    if a == b:
        return "match", seconds, len(got)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", seconds, len(got)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} rows differ, first {diff[0]}", seconds, len(got)


if __name__ == "__main__":
    from penstock.plans.catalog import ORACLES, QUERIES
    from penstock.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            verdict, seconds, n = compare(spark, sf, name, run, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            verdict, seconds, n = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0, -1
        bad += verdict not in ("match", "rows")
        print(f"{name:36s} {seconds:7.2f}s {n:8d} {verdict}", flush=True)
    print("bad", bad)
