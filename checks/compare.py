"""Run registered queries next to their SQL and compare whole results.

    python -m checks.compare /root/testdata/sf0.01 [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def _rows(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(set(names) ^ set(df.columns))}"
    if ours != theirs:
        a, b = list((ours - theirs).elements()), list((theirs - ours).elements())
        return (
            f"{sum(ours.values())} rows against {sum(theirs.values())};"
            f" {len(a)} only in Spark, {len(b)} only in SQL\n"
            f"    columns {sorted(names)}\n    spark {sorted(map(str, a))[:2]}\n"
            f"    sql   {sorted(map(str, b))[:2]}"
        )
    return None


def main() -> None:
    from bomdrift.session import local_session
    from checks.registry import ORACLE, QUERIES

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:]) or ("",)
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = compare(spark, con, run, ORACLE[name], sf_dir)
                rows = ""
            else:
                problem, rows = None, f" rows only: {run(spark, sf_dir).count()}"
        except Exception as error:  # report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{rows}"
              + (f"\n  {problem}" if problem else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
