"""Run queries and their SQL twins side by side: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: df[c].map(lambda v: "NULL" if v is None or v != v else str(v)) for c in sorted(df.columns)})
    return out.sort_values(list(out.columns), kind="stable").reset_index(drop=True) if len(out.columns) else out


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = canonical(left), canonical(right)
    if a.equals(b):
        return None
    rows = (a != b).any(axis=1)
    return f"{rows.sum()} of {len(a)} rows differ\n{a[rows].head(4).to_string()}\n{b[rows].head(4).to_string()}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from talentloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, bad = database(folder), oracle_sql(), []
    for name, build in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            left = build(spark, folder).toPandas()
            took = time.time() - started
            if name not in twins:
                print(f"rows  {name} {len(left)} {took:.1f}s", flush=True)
                continue
            started = time.time()
            right = con.execute(twins[name]).df()
            problem = difference(left, right)
        except Exception as e:  # noqa: BLE001
            problem, took = f"{type(e).__name__}: {str(e)[:900]}", time.time() - started
        if problem:
            bad.append(name)
        print(f"{'ok   ' if not problem else 'DIFF '} {name} {len(left) if 'left' in dir() else '-'} {took:.1f}s {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
