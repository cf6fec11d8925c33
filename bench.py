"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS]; prints one JSON line.  Each query is timed end to end (plan + execute,
result written to a no-op sink): the first run of the set, which also builds the derived tables,
is reported as cold; the value is the sum of the medians of $BENCH_REPS warm runs per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens import catalog  # noqa: E402
from marketlens.session import get_session  # noqa: E402

HEADLINE = ["risk_features", "technical_indicators", "drawdown_1y", "ytd_performance", "compare_valuation",
            "compare_health", "dcf_base", "mc_summary", "historical_pe", "header_facts", "yield_curve",
            "sentiment_summary", "two_tier_prices", "upsert_prices", "tick_bars"]


def run(spark, name, sf_dir):
    t0 = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    cold = {n: round(run(spark, n, sf_dir), 3) for n in names}   # builds the derived tables; JIT, file listing
    times = {}
    for n in names:
        times[n] = round(statistics.median(run(spark, n, sf_dir) for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": round(sum(cold.values()), 3), "cold_queries": cold, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "reps": reps}))


if __name__ == "__main__":
    main()
