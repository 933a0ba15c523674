"""Compare each registered Spark query with its DuckDB oracle.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
Row count, column names and an order-insensitive hash of normalised values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tradeflow.plans.fixtures import BASE_TABLES  # noqa: E402
from tradeflow.plans.registry import load_all  # noqa: E402
from tradeflow.session import build_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if v != v:
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in sorted(v.items())}
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session()
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    results = {}
    for name, q in load_all().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = q.fn(spark, sf_dir)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
            t_spark = time.time() - t0
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        if not q.oracle:
            results[name] = f"rows={len(srows)} (no oracle) spark={t_spark:.1f}s"
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        try:
            cur = con.execute(q.oracle)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"ORACLE ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        t_duck = time.time() - t1
        hs, ls = digest(cols, srows)
        ho, lo = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(srows) == len(orows) and hs == ho
        msg = f"{'OK ' if ok else 'BAD'} rows={len(srows)}/{len(orows)} spark={t_spark:.1f}s duck={t_duck:.1f}s"
        if sorted(cols) != sorted(ocols):
            msg += f" cols {sorted(cols)} vs {sorted(ocols)}"
        elif not ok:
            a, b = set(ls), set(lo)
            msg += f"\n   spark-only {sorted(a - b)[:3]}\n   oracle-only {sorted(b - a)[:3]}"
        results[name] = msg
        print(name, msg, flush=True)
    bad = [n for n, m in results.items() if not m.startswith("OK") and "no oracle" not in m]
    print(f"\n{len(results) - len(bad)}/{len(results)} ok; bad: {bad}")


if __name__ == "__main__":
    main()
