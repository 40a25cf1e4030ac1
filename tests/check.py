"""Runs registered queries next to their SQL and compares the rows.

``python tests/check.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, bool) or value is None:
        return repr(value)
    return f"{type(value).__name__}:{value!r}"


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql: str, folder: str) -> list[str]:
    """Differences between both results; empty when they agree."""
    df = run(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    if len(mine) != len(theirs):
        return [f"rows {len(mine)} / {len(theirs)}"]
    a, b = _canonical(df.columns, mine), _canonical(names, theirs)
    return [f"{x} / {y}"[:600] for x, y in zip(a, b) if x != y][:2]


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from voxtally.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    runs, sqls, bad = queries(), oracle_sql(), 0
    for name in names or runs:
        start = time.time()
        try:
            if name in sqls:
                found = compare(spark, con, runs[name], sqls[name], folder)
            else:
                found = [] if runs[name](spark, folder).count() else ["no rows"]
        except Exception as e:  # one failing query must not hide the others
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(found)
        kind = "" if name in sqls else " (rows only)"
        print(f"{'BAD' if found else 'ok '} {time.time() - start:6.2f}s {name}{kind}", flush=True)
        for line in found:
            print("     ", line, flush=True)
    print(f"{bad} of {len(names or runs)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    args = sys.argv[1:]
    path = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(main(path, args))
