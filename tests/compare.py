"""Run named queries against DuckDB on the same tables and compare the rows.

    python tests/compare.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def local_session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marketlens")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def kind(type_text: str) -> str:
    """Type names of both engines on one scale, so a schema drift shows."""
    t = type_text.lower()
    for names, out in (
        (("bigint", "long"), "bigint"),
        (("int", "integer"), "int"),
        (("double",), "double"),
        (("string", "varchar"), "string"),
        (("boolean",), "boolean"),
        (("timestamp", "timestamp_ntz"), "timestamp"),
    ):
        if t in names:
            return out
    return t


def check(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_kinds = {d[0]: kind(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return len(got), f"columns {sorted(df.columns)} / {sorted(want_names)}"
    got_kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    if got_kinds != want_kinds:
        diff = {n: (got_kinds[n], want_kinds[n]) for n in got_kinds if got_kinds[n] != want_kinds[n]}
        return len(got), f"types {diff}"
    a, b = canonical(got, df.columns), canonical(want, want_names)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return len(got), f"rows {len(a)}/{len(b)} spark-only {only_a} sql-only {only_b}"
    return len(got), None


def main() -> int:
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session(), duck(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            rows, error = check(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as e:  # report and go on to the next query
            rows, error = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += error is not None
        mark = "ok " if error is None else "BAD"
        kindof = "sql" if name in oracles else "rows"
        print(f"{mark} {kindof:4} {time.time() - start:6.2f}s {rows:8d} {name} {(error or '')[:1800]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
