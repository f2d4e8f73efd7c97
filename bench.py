"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Each query runs once over its
whole tables into a sink that discards the rows, after one unmeasured query that starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from runlens.plans.queries import REGISTRY
from runlens.session import build_session

HEADLINE = (
    "decoded_events", "valid_and_quarantined", "safe_fields", "run_features", "recent_hp",
    "upgrade_maps", "run_snapshots", "upgrades_at_triggers", "fights_with_snapshots",
    "enriched_records", "training_rows", "bootstrap_tables", "record_counts", "z_scores",
    "kill_alignments", "enemy_forms", "enemy_form_changes", "stale_enemy_forms", "dash_modes",
    "prediction_changes", "bargain_offers", "result_messages", "model_weights",
    "scored_encounters", "comment_prompts", "streamed_snapshots",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    REGISTRY["dash_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "spark": spark.version, "master": f"local[{cpus}]", "shuffle_partitions": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
