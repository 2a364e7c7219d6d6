"""Time the headline queries and print one JSON line.

The store is built once and timed as its own query, as a run builds it once and
then answers from it; every other query is timed from the store to its last row.
"""

import json
import os
import sys
import time

from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "s7_store", "a3_adoption", "a5_conversion_gap", "a8_sliding_adoption", "a12_migrations",
    "a13_substitution", "a16_contrast", "a20_weekly_averages", "w3_novelty", "d1_hype", "d2_fringe",
    "d3_pet_items", "d4_departure", "d7_breakthroughs", "m1_ledger", "m2_lineage", "r1_slot_audit",
    "j11_unplayed", "j12_changes", "d9_index_difference", "s2_event_flatten", "j17_densify", "st2_sliding_tally",
)


def main() -> None:
    from basketlens.plans import catalog
    from basketlens.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="basketlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.query(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
