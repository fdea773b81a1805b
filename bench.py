"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores. Every
query starts from the parquet files: shared intermediate tables are dropped
between queries, so each time includes what the query needs. ``warm`` repeats
each query once.
"""

from __future__ import annotations

import json
import os
import time

from eraloom.catalog import registry, shared
from eraloom.catalog.evaluation import COMPARISONS, ens
from eraloom.operators import bootstrap
from eraloom.session import local_session

HEADLINE = [
    "pip3_bucket_events", "pip4_episode_history", "pip7_condition_era_90", "pip8_win3_backfill_long", "pip8_no_backfill_long",
    "pip14_ag9_examples", "pip1_persistent_codes", "ev6_metrics_by_seed", "cf6_perturbed_era_sequences", "dq10_audit_status",
]


def run(df) -> int:
    df.write.format("noop").mode("overwrite").save()
    return 0


def paired_bootstrap_1000(spark, sf_dir):
    return bootstrap.run_comparisons(ens(spark, sf_dir), COMPARISONS, 1000)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    found = registry()
    todo = {name: found[name][0] for name in HEADLINE} | {"ev12_paired_bootstrap_1000": paired_bootstrap_1000}
    only = os.environ.get("BENCH_ONLY")
    if only:
        todo = {k: v for k, v in todo.items() if k.startswith(tuple(only.split(",")))}
    cold, warm = {}, {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name, query in todo.items():
        for times in (cold, warm):
            shared.forget()
            start = time.perf_counter()
            run(query(spark, sf_dir))
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
