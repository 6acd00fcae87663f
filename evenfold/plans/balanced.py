"""A fixed number of balanced groups per cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.operators.balance import group_members
from evenfold.operators.lloyd import MAX_ROUNDS, kmeans
from evenfold.operators.locking import fix_diversity_isolation, fix_gender_isolation
from evenfold.operators.seeding import check_clusters, group_config, init_medoids
from evenfold.plans.cohorts import label_people, prepare


def form_balanced_groups(people: DataFrame, n_groups: int, seed: int = 42, enforce_gender_balance: bool = True,
                         enforce_diversity_balance: bool = True, max_iter: int = MAX_ROUNDS,
                         max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """People with a 1-based ``Group``, and one row per group member, empty groups included.

    K-Means, then lone genders and lone diversity categories are ended by swaps, each behind
    its flag; diversity swaps keep genders in place while genders are enforced.
    """
    cohorts = prepare(people)
    config = group_config(cohorts.people, 1, k=n_groups)
    check_clusters(config)
    slots = init_medoids(cohorts.people, cohorts.profiles, config, seed=seed)
    labels, _ = kmeans(cohorts.profiles, slots, "euclidean", max_iter)
    labelled = label_people(cohorts, labels).withColumnRenamed("label", "group_id")
    if enforce_gender_balance:
        labelled, _ = fix_gender_isolation(labelled, cohorts.profiles, max_rounds=max_rounds)
    if enforce_diversity_balance:
        labelled, _ = fix_diversity_isolation(labelled, cohorts.profiles, enforce_gender_balance, max_rounds=max_rounds)
    members = group_members(labelled, config).withColumn("Group", F.col("group_id") + 1).drop("group_id")
    grouped = labelled.withColumn("Group", F.col("group_id") + 1).drop("group_id", "profile_id")
    return grouped, members
