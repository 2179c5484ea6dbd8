"""Compare every registered query with its SQL on DuckDB.

Usage: python tests/oracle.py [sf_dir] [name substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows), [columns[i] for i in order]


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description of the first difference."""
    got, got_columns = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want, want_columns = table(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    differing = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else None


def main(argv: list[str]) -> int:
    from tests.session import session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    import __spark_entry__ as e

    spark, con, sql = session(), connect(sf_dir), e.oracle_sql()
    bad = 0
    for name, run in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(run(spark, sf_dir), con, sql[name])
            else:
                problem = None if run(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:42s} {time.time() - start:6.2f}s "
              f"{'sql' if name in sql else 'rows'} {problem or ''}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
