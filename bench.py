"""Times the headline queries over $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from varve import registry  # noqa: E402
from varve.session import session  # noqa: E402

#: Tiers, facts, ledger, as-of and interval joins, profiles, fusion, graph, claims.
HEADLINE = [
    "flagship", "c01_tier_mask", "c04_reconcile", "a11_upsert", "d02_project", "d24_brier", "d25_report", "c05_as_of", "c07_interval_join",
    "d05_profile", "d12_fusion", "d12_inner_fusion", "d14_decision", "c19_frontier", "d33_floors", "d34_budgets", "e07_supersession", "t7_rename", "a11_upsert_hours", "t2_settle_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, "bench", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for table in ("events", "orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
