"""Compare registered queries with their SQL on the same parquet files.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def _kind(value):
    if isinstance(value, decimal.Decimal):
        return "decimal"
    return type(value).__name__


def compare(spark_rows, columns, sql_rows, sql_columns) -> str | None:
    """None when equal, else what differs."""
    if sorted(columns) != sorted(sql_columns):
        return f"columns {sorted(columns)} != {sorted(sql_columns)}"
    order = sorted(columns)
    a_at = [columns.index(c) for c in order]
    b_at = [sql_columns.index(c) for c in order]
    a = sorted(tuple(_cell(r[i]) for i in a_at) for r in spark_rows)
    b = sorted(tuple(_cell(r[i]) for i in b_at) for r in sql_rows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{dict(zip(order, x))} != {dict(zip(order, y))}"[:600]
    for i, j, c in zip(a_at, b_at, order):
        kinds = {_kind(r[i]) for r in spark_rows if r[i] is not None}, {_kind(r[j]) for r in sql_rows if r[j] is not None}
        if kinds[0] != kinds[1]:
            return f"type of {c}: {kinds}"
    return None


def check(spark, con, folder: str, name: str, run, sql: str | None, plans: list | None = None):
    start = time.time()
    frame = run(spark, folder)
    if plans is not None:
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
    rows = [tuple(r) for r in frame.collect()]
    seconds = time.time() - start
    if sql is None:
        return seconds, len(rows), None
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return seconds, len(rows), compare(rows, frame.columns, result.fetchall(), columns)


def main() -> None:
    from gridsmith.testing import local_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(a in n for a in args)]
    bad = 0
    for name in names:
        try:
            seconds, rows, problem = check(spark, con, folder, name, queries[name], sql.get(name))
        except Exception as error:  # report and go on with the others
            seconds, rows, problem = 0.0, -1, f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        state = "ok" if problem is None else "DIFF"
        print(f"{state:5}{'' if name in sql else '(rows only) '}{name} {rows} rows {seconds:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
