"""Run registered queries against their comparison SQL: ``python tests/check.py SF [name...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from strikebook.plans.frames import TABLES  # noqa: E402

ROOT = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(con, spark, plan, sql, sf_dir):
    """None when both sides agree, else what differs; with the Spark row count and seconds."""
    started = time.time()
    frame = plan(spark, sf_dir)
    left_columns = frame.columns
    left = frame.collect()
    seconds = time.time() - started
    if sql is None:
        return None, len(left), seconds
    cursor = con.execute(sql)
    right_columns = [d[0] for d in cursor.description]
    right = cursor.fetchall()
    if sorted(left_columns) != sorted(right_columns):
        return f"columns {sorted(left_columns)} vs {sorted(right_columns)}", len(left), seconds
    a, b = rows_of(left_columns, left), rows_of(right_columns, right)
    if a == b:
        return None, len(left), seconds
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return (
        f"{len(a)} vs {len(b)} rows; columns {sorted(left_columns)}\n   spark  {only_a}\n   duckdb {only_b}",
        len(left),
        seconds,
    )


def main() -> int:
    from strikebook.session import local_session

    import __spark_entry__ as entry

    sf_dir = f"{ROOT}/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, plan in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, n, seconds = compare(con, spark, plan, sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, n, seconds = f"{type(error).__name__}: {str(error)[:900]}", -1, 0.0
        mark = "ok  " if problem is None else "FAIL"
        note = "" if name in sql else " (no SQL)"
        print(f"{mark} {name:38s} rows={n:7d} {seconds:6.2f}s{note}", flush=True)
        if problem:
            bad += 1
            print("   " + problem, flush=True)
        elif n == 0:
            print("   EMPTY", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
