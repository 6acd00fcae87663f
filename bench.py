"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS (default 8) the cores.
Every query runs to its full result, written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import query_catalog  # noqa: E402
from evenfold.plans.generate import generate_groups  # noqa: E402
from evenfold.plans.tournament import tournament  # noqa: E402
from evenfold.session import build_session  # noqa: E402
from evenfold.sources.learners import learners  # noqa: E402

GROUP_SIZE = 30

HEADLINES = {
    **{name: query_catalog.QUERIES[name] for name in (
        "validate_people", "standardize", "silhouette_euclidean", "evaluate_clustering", "cluster_balance",
        "kmeans_euclidean", "kmedoids_manhattan", "kmedoids_gower", "enforce_group_size", "fix_gender_isolation")},
    "generate_groups_30": lambda spark, sf: generate_groups(learners(spark, sf), GROUP_SIZE).assignments,
    "tournament_30": lambda spark, sf: tournament(learners(spark, sf), GROUP_SIZE).table,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR",
    })
    learners(spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or list(HEADLINES)
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        HEADLINES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
