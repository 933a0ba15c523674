"""Headline-query benchmark.

Runs every query registered with ``bench=True`` on ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE
JSON line. Each query is executed fully through the ``noop`` sink (every
row produced, nothing collected to the driver). A warm-up query runs first
so JVM start-up is not charged to the first headline query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tradeflow.plans.registry import load_all  # noqa: E402
from tradeflow.session import build_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()
    queries = {n: q for n, q in load_all().items() if q.bench}
    only = set(sys.argv[1:])
    run(spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count())  # warm-up
    times: dict[str, float] = {}
    for name, q in queries.items():
        if only and name not in only:
            continue
        t0 = time.time()
        run(q.fn(spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf}
    # growth of the two linkage joins from a 10x smaller input (the reference's
    # loops are O(names x texts); blocked joins should grow ~linearly)
    small = os.environ.get("BENCH_SMALL_SF_DIR", "/root/testdata/sf0.01")
    if not only and os.path.isdir(small) and os.path.abspath(small) != os.path.abspath(sf_dir):
        growth = {}
        for name in ("job_quote_mapping", "cost_links"):
            if name in queries and name in times:
                t0 = time.time()
                run(queries[name].fn(spark, small))
                t_small = time.time() - t0
                spark.catalog.clearCache()
                growth[name] = {"small_sec": round(t_small, 3), "ratio": round(times[name] / max(t_small, 1e-9), 2)}
        out["linkage_growth"] = growth
    print(json.dumps(out))


if __name__ == "__main__":
    main()
