"""Run every registered query and its DuckDB oracle side by side.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: rows, column names and an order-insensitive
comparison of values.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from rowsmith import get_spark
    import __spark_entry__ as entry

    spark = get_spark("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if only and k not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        el = time.time() - t0
        if k not in sqls:
            print(f"{k:32s} rows={len(rows):7d} (no oracle) {el:.1f}s")
            continue
        try:
            res = con.execute(sqls[k])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SQL-ERROR {str(e)[:300]}")
            bad += 1
            continue
        c1, v1 = canon(cols, rows)
        c2, v2 = canon(ocols, orows)
        ok = c1 == c2 and v1 == v2
        bad += not ok
        msg = "OK" if ok else "MISMATCH"
        print(f"{k:32s} rows={len(rows):7d}/{len(orows):7d} {msg} {el:.1f}s")
        if not ok:
            if c1 != c2:
                print("   cols", c1, c2)
            else:
                diff1 = [r for r in v1 if r not in set(v2)][:3]
                diff2 = [r for r in v2 if r not in set(v1)][:3]
                print("   spark-only", diff1)
                print("   oracle-only", diff2)
    print("FAILURES", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
