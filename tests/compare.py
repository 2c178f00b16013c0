"""Run queries next to their SQL in DuckDB and report differences.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """Empty when equal, otherwise a short description."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        only_got = sorted(set(got) - set(want), key=repr)[:3]
        only_want = sorted(set(want) - set(got), key=repr)[:3]
        return f"{len(got)} rows vs {len(want)}; only spark {only_got}; only sql {only_want}", len(got)
    return "", len(got)


def main(argv):
    from tests.session import session

    sys.path.insert(0, ".")
    import __spark_entry__ as entry_point

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = session()
    con = connect(sf_dir)
    sqls = entry_point.oracle_sql()
    bad = 0
    for name, query in entry_point.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        t0 = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                diff, n = differences(df, con, sqls[name])
            else:
                diff, n = "", df.count()
        except Exception as e:  # report and go on with the next query
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += bool(diff)
        print(f"{name:28s} {'sql' if name in sqls else 'rows':4s} {n:7d} {time.time() - t0:6.1f}s {'OK' if not diff else 'DIFF ' + diff[:1500]}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
