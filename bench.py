"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores; BENCH_RUNS: timed runs per query
(after one warm-up run), of which the fastest counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from noticeflow.checks.compare import session  # noqa: E402
from noticeflow.checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "notices_closing_next", "l8_candidates", "l5_first_n", "d4_lookup", "d5_undecodable", "w2_manifest",
    "x15_extract", "x15_bulletins", "x15_documents", "a2_ingest", "a3_overlay", "v3_trusted",
    "k1_fingerprint", "k3_classify", "k4_upsert", "r2_number", "r4_detail", "e5_audit", "stream_upsert",
)


def timed(spark, sf_dir, name):
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        timed(spark, sf_dir, name)
        seconds[name] = round(min(timed(spark, sf_dir, name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
