"""Compare registered queries with their SQL on DuckDB: rows, column names and values.

Run as a script: python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return repr(round(x, 4) + 0.0)
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(cell(y) for y in x) + "]"
        return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns differ: {sorted(df.columns)} vs {sorted(columns)}", len(got)
    a, b = normal(got, df.columns), normal(want, columns)
    if a != b:
        sa, sb = set(a), set(b)
        return (f"{len(a)} vs {len(b)} rows; columns {sorted(columns)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"), len(got)
    return None, len(got)


def main() -> None:
    import __spark_entry__ as e
    from factloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    spark = build_session("oracle", master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in e.oracle_sql():
                problem, rows = compare(spark, con, e.queries()[n], e.oracle_sql()[n], sf_dir)
            else:
                problem, rows = None, e.queries()[n](spark, sf_dir).count()
        except Exception as err:  # noqa: BLE001
            problem, rows = "".join(traceback.format_exception_only(type(err), err))[:1500], -1
        bad += problem is not None
        kind = "sql " if n in e.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {n} rows={rows} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} failing")


if __name__ == "__main__":
    main()
