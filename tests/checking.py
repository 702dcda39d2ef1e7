"""Compare named queries with their SQL on the same Parquet tables.

``python tests/checking.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def value(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(value(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return con


def compare(spark, con, folder, name, query, sql):
    compare.started = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_seconds = time.time() - compare.started
    kinds = dict(df.dtypes)
    if sql is None:
        return len(got[1]), "rows only", kinds
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    duck_kinds = {d[0]: str(d[1]) for d in cursor.description}
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} != {want[0]}", kinds
    for c in got[0]:
        pair = (kinds[c], duck_kinds[c])
        if pair not in {
            ("bigint", "BIGINT"), ("string", "VARCHAR"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"),
            ("int", "INTEGER"), ("timestamp_ntz", "TIMESTAMP"), ("date", "DATE"),
        }:
            return len(got[1]), f"type of {c}: {pair}", kinds
    if len(got[1]) != len(want[1]):
        return len(got[1]), f"{len(got[1])} rows != {len(want[1])}", kinds
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return len(got[1]), f"{len(bad)} rows differ, first {str(bad[0])[:1500]}", kinds
    return len(got[1]), "ok", kinds


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.001"
    from __spark_entry__ import oracle_sql, queries
    from ledgermill.session import build_session

    spark = build_session(
        **{"spark.master": "local[8]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
           "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checking-"), "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql, bad = oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start, compare.spark_seconds = time.time(), 0.0
        try:
            n, verdict, _ = compare(spark, con, folder, name, query, sql.get(name))
        except Exception as error:  # keep going, report at the end
            n, verdict = -1, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {n:7d} {compare.spark_seconds:6.2f}s {time.time() - start - compare.spark_seconds:6.2f}s {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
