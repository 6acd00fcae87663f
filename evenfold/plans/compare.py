"""Two metrics side by side on the same start."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evenfold.operators.balance import as_run
from evenfold.operators.lloyd import MAX_ROUNDS, kmeans
from evenfold.operators.medoids import MAX_SWAPS, kmedoids
from evenfold.operators.seeding import check_clusters, group_config, init_medoids
from evenfold.operators.sizing import enforce_group_size
from evenfold.plans.cohorts import label_people, prepare
from evenfold.session import checkpoint


def compare_metrics(people: DataFrame, n_clusters: int, seed: int = 42, use_kmedoids: bool = True,
                    group_size: int | None = None, max_rounds: int = MAX_ROUNDS,
                    max_swaps: int = MAX_SWAPS) -> DataFrame:
    """``run, cohort_id, row_id, group_id`` of K-Means L2 and of K-Medoids or K-Means L1.

    With ``group_size`` both are resized; left-over people are then dealt out in turn.
    """
    cohorts = prepare(people)
    config = group_config(cohorts.people, 1, k=n_clusters)
    check_clusters(config)
    slots = checkpoint(init_medoids(cohorts.people, cohorts.profiles, config, seed=seed))

    def finish(run: str, labels: DataFrame) -> DataFrame:
        rows = label_people(cohorts, labels)
        sized = (rows.withColumnRenamed("label", "group_id") if group_size is None
                 else enforce_group_size(rows, group_size))
        return as_run(sized, run).select("run", "cohort_id", "row_id", "group_id")

    first, _ = kmeans(cohorts.profiles, slots, "euclidean", max_rounds)
    if use_kmedoids:
        name = "kmedoids_manhattan"
        second, _ = kmedoids(cohorts.profiles, slots, "manhattan", max_swaps)
    else:
        name = "kmeans_manhattan"
        second, _ = kmeans(cohorts.profiles, slots, "manhattan", max_rounds)
    return finish("kmeans_euclidean", first).unionByName(finish(name, second))
