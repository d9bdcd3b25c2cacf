"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is forced end to end with a ``noop`` write (full computation, no
collect to the driver).  The JVM and Python workers are warmed up on a tiny
query first so the first timing does not include start-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ingest_scan",          # secrets + PII + hidden instructions + redaction per document
    "pii_redact",
    "secret_scan",
    "chunk_fixed",
    "chunk_recursive",
    "vector_topk",          # exact top-k, tenant scoped
    "acl_retrieve",         # global top-20 + RBAC filter
    "guarded_retrieval",
    "guarded_answers",      # full query pipeline
    "audit_log",
    "events_feed",
    "dp_embed",
    "dp_audit",
    "dp_budget",
    "rate_limit",
    "circuit_open",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    from docshield.session import get_spark
    from docshield.plans import catalog

    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    spark.range(1000).selectExpr("sum(id)").collect()
    # warm the JIT and the Python workers on the flagship query at the smallest scale
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for q in ("ingest_scan", "vector_topk"):
        catalog.QUERIES[q](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
