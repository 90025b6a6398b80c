"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from likeness.plans.register import QUERIES  # noqa: E402
from likeness.session import local_session  # noqa: E402

HEADLINE = [
    "centroid_by_group", "leakage_delta", "encounter_accuracy", "knn_vote", "verification_auc", "probe_by_group",
    "closed_set_frozen", "open_set_auroc", "few_shot_5", "domain_shift_centroid", "within_stratum",
    "kinship_permutation", "thinning_experiment", "split_structure", "group_kfold_customers", "ami",
    "frame_delta", "group_normalise", "content_digest", "table_diff", "describe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    QUERIES["centroid_by_group"](spark, sf_dir).count()  # start the JVM and the Python workers
    times = {}
    for name in names:
        samples = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(samples), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "master": f"local[{cpus}]",
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
