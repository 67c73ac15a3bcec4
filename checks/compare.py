"""Run queries on Spark and their twins on DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _cell(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        number = float(v)
        return "~" if number != number else f"{number + 0.0:.6f}"
    if isinstance(v, pd.Timestamp):
        return v.date().isoformat()
    return str(v)


def canonical(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(set(left.columns) ^ set(right.columns))}"
    a, b = canonical(left), canonical(right)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    only = list(sa - sb)[:2], list(sb - sa)[:2]
    return f"rows {len(a)} vs {len(b)}, differing {len(sa - sb)}/{len(sb - sa)}: {only}"


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from checks.catalog import QUERIES

    sf_dir = f"/root/testdata/sf{argv[0]}"
    names = argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="paceframe-compare-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        q = QUERIES[name]
        t = time.time()
        try:
            left = q.spark(spark, sf_dir).toPandas()
            took, t = time.time() - t, time.time()
            if q.sql is None:
                print(f"rows  {name} {len(left)} {took:.1f}s", flush=True)
                continue
            problem = difference(left, con.execute(q.sql).df())
            mark = "ok   " if problem is None else "DIFF "
            print(f"{mark} {name} {len(left)} {took:.1f}s/{time.time() - t:.1f}s {problem or ''}"[:1500], flush=True)
            bad += problem is not None
        except Exception as e:
            bad += 1
            print(f"FAIL  {name} {type(e).__name__} {str(e)[:900]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
