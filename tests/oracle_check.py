"""Run registered queries against their DuckDB oracles (like the driver).

    python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive multiset of
normalised values.  Prints one line per query and exits non-zero on a
mismatch.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if v != v:
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from botlens.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, oracles = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in oracles:
            print(f"{name:32s} rows={len(s_rows):6d} (no oracle) spark={t1 - t0:.1f}s")
            continue
        res = con.execute(oracles[name])
        o_cols = [d[0] for d in res.description]
        o_rows = res.fetchall()
        ok_cols = sorted(s_cols) == sorted(o_cols)
        a, b = canon(s_cols, s_rows), canon(o_cols, o_rows)
        ok = ok_cols and a == b
        bad += not ok
        print(f"{name:32s} rows={len(s_rows):6d}/{len(o_rows):6d} cols={'ok' if ok_cols else 'DIFF'} "
              f"values={'ok' if a == b else 'DIFF'} spark={t1 - t0:.1f}s")
        if not ok:
            if not ok_cols:
                print("   spark:", sorted(s_cols), "\n   duck: ", sorted(o_cols))
            sa, sb = set(a), set(b)
            for r in list(sa - sb)[:3]:
                print("   spark only:", r)
            for r in list(sb - sa)[:3]:
                print("   duck only: ", r)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
