"""Run registered Spark queries and their DuckDB oracle SQL side by side.

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sigspark.bindings import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return f"ROWS   {name}: spark={len(srows)} ({t1 - t0:.1f}s, no oracle)"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    sc, sr = rows_of(scols, srows)
    dc, dr = rows_of(dcols, drows)
    if sc != dc:
        return f"MISMATCH {name}: columns spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return f"MISMATCH {name}: rows spark={len(sr)} duck={len(dr)}"
    if sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
        return f"MISMATCH {name}: values differ ({len(sr)} rows) e.g. {bad}"
    return f"OK     {name}: rows={len(sr)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from __spark_entry__ import oracle_sql, queries
    from sigspark.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            line = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            line = f"ERROR  {name}: {type(e).__name__}: {str(e)[:400]}"
        if not (line.startswith("OK") or line.startswith("ROWS")):
            bad += 1
        print(line, flush=True)
    print(f"-- {bad} problem(s) in {len(qs) if not only else len(only)} queries")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
