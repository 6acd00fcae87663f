"""Four clusterings of every cohort, resized and scored in one table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from evenfold.operators.balance import as_run, cluster_balance, skill_variance_overall
from evenfold.operators.lloyd import MAX_ROUNDS, kmeans
from evenfold.operators.medoids import MAX_SWAPS, kmedoids
from evenfold.operators.profiles import FULL_KEYS, attach_profiles, encode
from evenfold.operators.seeding import check_clusters, check_group_size, group_config, init_medoids
from evenfold.operators.sizing import enforce_group_size
from evenfold.plans.cohorts import Cohorts, label_people, prepare
from evenfold.plans.evaluate import best_run, comparison_table, evaluate_runs, named_runs
from evenfold.session import checkpoint

SEED = 42


@dataclass(frozen=True)
class Tournament:
    labelled: DataFrame
    scores: DataFrame
    cohorts: Cohorts

    @property
    def table(self) -> DataFrame:
        return comparison_table(self.scores)

    @property
    def named_scores(self) -> DataFrame:
        return named_runs(self.scores)

    @property
    def best(self) -> DataFrame:
        return best_run(self.scores)

    @property
    def balance(self) -> DataFrame:
        return cluster_balance(self.labelled)

    @property
    def skill_variance(self) -> DataFrame:
        return skill_variance_overall(self.labelled)


def tournament(people: DataFrame, group_size: int = 5, n_clusters: int | None = None, seed: int = SEED,
               max_rounds: int = MAX_ROUNDS, max_swaps: int = MAX_SWAPS, fit_scope: str = "cohort") -> Tournament:
    """K-Means (L2, L1) and K-Medoids (L1, Gower), each resized to ``group_size`` and scored."""
    size = check_group_size(group_size, "evaluate")
    cohorts = prepare(people, fit_scope=fit_scope)
    config = group_config(cohorts.people, size, "evaluate", n_clusters)
    check_clusters(config)
    full = encode(cohorts.people.drop("profile_id"), FULL_KEYS, fit_scope)
    wide = Cohorts(attach_profiles(cohorts.people.drop("profile_id"), full, FULL_KEYS), full, cohorts.quarantine, FULL_KEYS)
    slots = checkpoint(init_medoids(cohorts.people, cohorts.profiles, config, seed=seed))

    def named(run: str, labels: DataFrame, source: Cohorts = cohorts) -> DataFrame:
        rows = label_people(source, labels)
        if source is not cohorts:
            rows = attach_profiles(rows.drop("profile_id"), cohorts.profiles)
        return as_run(rows, run)

    def resized(rows: DataFrame, metric: str) -> DataFrame:
        return enforce_group_size(rows, size, cohorts.profiles, metric, ("run", "cohort_id")).drop("label")

    euclidean, _ = kmeans(cohorts.profiles, slots, "euclidean", max_rounds)
    manhattan, _ = kmeans(cohorts.profiles, slots, "manhattan", max_rounds)
    swapped, _ = kmedoids(cohorts.profiles, slots, "manhattan", max_swaps)
    first = init_medoids(wide.people, wide.profiles, config, FULL_KEYS, seed)
    mixed, _ = kmedoids(wide.profiles, first, "gower", max_swaps)
    by_manhattan = [named("kmeans_manhattan", manhattan), named("kmedoids_manhattan", swapped),
                    named("kmedoids_gower", mixed, wide)]
    runs = [resized(named("kmeans_euclidean", euclidean), "euclidean"),
            resized(reduce(DataFrame.unionByName, by_manhattan), "manhattan")]
    labelled = checkpoint(reduce(DataFrame.unionByName, runs))
    return Tournament(labelled, evaluate_runs(labelled, cohorts.profiles, ("kmedoids_gower",)), cohorts)
