"""Run queries on Spark and their SQL on DuckDB over the same tables and compare whole results.

Usage: python -m tests.oracle [name-part ...] ; ORACLE_SF_DIR picks the tables.
"""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(path):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, fn, sql, path):
    start = time.time()
    df = fn(spark, path)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return ("rows", len(got), took, "")
    start = time.time()
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    sql_took = time.time() - start
    if got_cols != want_cols:
        return ("COLUMNS", len(got), took, f"{got_cols} vs {want_cols}")
    if got != want:
        missing = [r for r in want if r not in set(got)][:2]
        extra = [r for r in got if r not in set(want)][:2]
        return ("DIFFER", len(got), took, f"want {len(want)} rows\n   sql {missing}\n   spark {extra}")
    return ("ok", len(got), took, f"sql {sql_took:.1f}s")


def main(patterns):
    import __spark_entry__ as contract
    from tidewright.session import local_session

    path = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    oracles = contract.oracle_sql()
    bad = []
    for name, fn in contract.queries().items():
        if patterns and not any(p in name for p in patterns):
            continue
        try:
            status, n, took, note = compare(spark, con, name, fn, oracles.get(name), path)
        except Exception as error:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0.0, str(error)[:1500]
        if status not in ("ok", "rows") or n == 0:
            bad.append(name)
        print(f"{status:8} {name:34} {n:7} rows {took:6.1f}s {note}", flush=True)
    print("BAD:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
