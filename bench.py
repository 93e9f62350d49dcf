"""Headline-query benchmark; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed once to warm the session (code generation, file
listing), then timed twice with the ``noop`` sink, which runs the whole
plan without collecting rows to the driver; the faster run is reported
(shared machines add noise).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "overview_star",            # Q7 on the star mapping (line items as messages)
    "overview_rollup_star",     # Q7 answered from a maintained daily rollup
    "dashboard_star",           # Q18, all parts, one row per bot
    "dashboard_rollup_star",    # Q18 from the maintained rollup and newest activity: no fact is read
    "owner_bots_star",          # Q21
    "recent_activity_star",     # Q17 top-10 per bot
    "overview",                 # Q7 on the events mapping
    "upsert_users",             # I9 snapshot + arrivals merge
    "ingest_api",               # I20: auth, quota, validation, bots, facts
    "contracts_report",         # I23
]


def build(spark, sf_dir):
    from pyspark.sql import functions as F

    from botlens.operators import stats
    from botlens.plans import catalog
    qs = catalog.queries()

    prebuilt = {}

    def dashboard_star(s, d):
        return stats.to_document_json(stats.dashboard(catalog.tables_b(s, d), catalog.B))

    def ingest_api(s, d):
        # the raw bodies are landed once, outside the timed run
        if "raw" not in prebuilt:
            prebuilt["raw"] = catalog._raw_api(s, d)
        from botlens.plans.ingest_batch import ingest_api_batch
        out = ingest_api_batch(prebuilt["raw"], catalog.tables_a(s, d), catalog.SECRETS, usage_at=catalog._no_usage(
            catalog.tables_a(s, d)))
        parts = [out.rejected.select(F.lit(1).alias("x"))]
        parts += [f.select(F.lit(1).alias("x")) for f in out.facts.values()]
        parts += [out.users_delta.select(F.lit(1).alias("x")), out.bots.select(F.lit(1).alias("x"))]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df

    from botlens.operators import recent, rollup
    from botlens.session import stage

    def overview_rollup_star(s, d):
        # the rollup is maintained by the ingest job; here it is built once
        # (outside the timed run) and the overview reads it
        t = catalog.tables_b(s, d)
        if "r" not in prebuilt:
            prebuilt["r"] = stage(rollup.full_rollup(t), "bench-rollup")
        return rollup.overview_from_rollup(t, prebuilt["r"], catalog.B)

    def dashboard_rollup_star(s, d):
        t = catalog.tables_b(s, d)
        if "r" not in prebuilt:
            prebuilt["r"] = stage(rollup.full_rollup(t), "bench-rollup")
        if "n" not in prebuilt:
            prebuilt["n"] = stage(recent.newest_daily(t.activity_logs), "bench-newest")
        return stats.to_document_json(rollup.dashboard_from_rollup(t, prebuilt["r"], catalog.B, newest=prebuilt["n"]))

    extra = {"dashboard_star": dashboard_star, "ingest_api": ingest_api,
             "overview_rollup_star": overview_rollup_star,
             "dashboard_rollup_star": dashboard_rollup_star}
    return {name: extra.get(name) or qs[name] for name in HEADLINE}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from botlens.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.local.dir": tempfile.mkdtemp(prefix="botlens-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    runs = build(spark, sf_dir)
    times = {}
    for name, fn in runs.items():
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()      # warm-up
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    size = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    rates = {"ingest_api": round(size("events") / times["ingest_api"]),
             "overview_star": round((size("lineitem") + 3 * size("orders")) / times["overview_star"])}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows_per_sec": rates, "sf": sf}))


if __name__ == "__main__":
    main()
