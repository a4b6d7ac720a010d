"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS (default 8) the local cores. Every
query runs to the end into Spark's no-op sink; the best of BENCH_RUNS (default 2) counts. A first pass
over the same queries on the smallest data warms the session up.
"""

from __future__ import annotations

import json
import os
import time

from sensitext.plans.catalog import QUERIES
from sensitext.settings import build_session

HEADLINE = (
    "pii_counts_documents", "pii_findings_documents", "pii_findings_customers", "pii_findings_pages",
    "redact_documents", "redact_customers", "redact_by_source", "restore_roundtrip_documents", "policy_clean_docs",
    "content_repeats", "authenticate", "rate_limit_admitted", "spend_by_user", "budget_gate", "ttl_cache_hits",
    "attempt_outcome", "gateway_decisions", "audit_rollup_hourly",
)


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__sensitext__textPartitions=cpus,
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in names:
        if os.path.isdir(warm):
            timed(spark, name, warm)
    seconds = {name: round(min(timed(spark, name, folder) for _ in range(runs)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
