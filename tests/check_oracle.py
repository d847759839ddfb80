"""Run registered queries beside their SQL and report differences.

``python tests/check_oracle.py [sf_dir] [name …]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as E  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple(None if v is None or v is pd.NA or v != v else (float(v) if isinstance(v, float) else (int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v)) for v in row))
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty if equal, else the first difference."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if len(a) != len(b):
        extra = next(iter(set(map(str, a)) ^ set(map(str, b))), "")
        return f"rows {len(a)} != {len(b)}; e.g. {extra[:300]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{str(x)[:400]}\n    != {str(y)[:400]}"
    return ""


def run(spark, sf_dir: str, names: list[str] | None = None) -> dict[str, str]:
    con, queries, sql, bad = duck(sf_dir), E.queries(), E.oracle_sql(), {}
    for name in names or list(queries):
        start = time.time()
        got = queries[name](spark, sf_dir).toPandas()
        took = time.time() - start
        problem = "no SQL" if name not in sql else compare(got, con.execute(sql[name]).df())
        print(f"{name:28s} {len(got):7d} rows {took:6.1f}s  {problem or 'ok'}", flush=True)
        if problem and problem != "no SQL":
            bad[name] = problem
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    failed = run(session, folder, sys.argv[2:] or None)
    print("FAILED", sorted(failed)) if failed else print("all equal")
