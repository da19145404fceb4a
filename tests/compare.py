"""Runs registered queries against their SQL: ``python -m tests.compare [folder] [name ...]``."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows only: {len(got)}" if got else "EMPTY"
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} / {sorted(columns)}"
    want = rows_of(columns, cur.fetchall())
    if got != want:
        diff = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return f"DIFF {len(got)}/{len(want)} rows, columns {sorted(columns)}: {str(diff)[:900]}"
    return f"ok {len(got)}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import new_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(queries())
    spark, con, sqls, fns = new_session(), connect(folder), oracle_sql(), queries()
    bad = 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, folder, name, fns[name], sqls.get(name))
        except Exception as e:  # report and go on
            result = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += not result.startswith(("ok", "rows only"))
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
