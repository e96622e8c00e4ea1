"""Run registered queries against their DuckDB twins: python -m tests.oracle [prefix ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return None if math.isnan(number) else number
    return str(value)


def _key(row):
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def normalise(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=_key)


TIMES = {}


def compare(spark_frame, connection, sql, began=None):
    """None when equal, else a short description of the first difference."""
    began = began or time.time()
    rows = [tuple(row) for row in spark_frame.collect()]
    TIMES["spark"] = time.time() - began
    left_names, left = normalise(spark_frame.columns, rows)
    cursor = connection.execute(sql)
    right_names, right = normalise([item[0] for item in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}", len(left)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}: {left[:2]} / {right[:2]}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {dict(zip(left_names, bad[0][0]))} / {bad[0][1]}", len(left)
    return None, len(left)


def main(argv):
    import __spark_entry__ as entry
    from sightline.session import build_session

    folder = "/root/testdata/sf0.01"
    prefixes = [item for item in argv if not item.startswith("/")]
    folder = next((item for item in argv if item.startswith("/")), folder)
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    twins, failed = entry.oracle_sql(), []
    for name, plan in entry.queries().items():
        if prefixes and not any(name.startswith(prefix) for prefix in prefixes):
            continue
        began = time.time()
        try:
            if name in twins:
                problem, count = compare(plan(spark, folder), connection, twins[name], began)
            else:
                problem, count = None, plan(spark, folder).count()
        except Exception as error:  # report and go on with the next query
            problem, count = f"{type(error).__name__}: {str(error)[:900]}", -1
        label = "ok" if problem is None else "FAIL"
        note = "" if name in twins else " (no twin)"
        print(f"{label:5}{name:40}{count:8} rows {TIMES.get("spark", 0):6.2f}s of {time.time() - began:6.2f}s{note} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
