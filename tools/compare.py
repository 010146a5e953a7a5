"""Run every registered query and compare it with its SQL on DuckDB.

    python tools/compare.py /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from sunledger.queries import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normalized(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_cell(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat().split("T00:00:00")[0]
    return value.item() if hasattr(value, "item") else value


def types_of(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normalized(got), normalized(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main(sf_dir: str, parts: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failures = connect(sf_dir), 0
    for key, run in QUERIES.items():
        if parts and not any(p in key for p in parts):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            spent = time.time() - start
            if key in ORACLES:
                want = con.execute(ORACLES[key]).df()
                problem = compare(got, want)
                if problem is None and types_of(got) != types_of(want):
                    problem = f"(types only) {[(c, t, types_of(want)[c]) for c, t in types_of(got).items() if t != types_of(want)[c]]}"
            else:
                problem = None if len(got) else "no rows"
        except Exception as error:  # noqa: BLE001
            spent, got, problem = time.time() - start, [], f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key:36s} {spent:6.2f}s {len(got):7d} {'sql' if key in ORACLES else 'rows'} {problem or ''}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
