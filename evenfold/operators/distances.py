"""Distances between the profiles of a cohort, each pair once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.functions.measure import pair_metric
from evenfold.operators.joins import pair_within, prefixed


def profile_distances(profiles: DataFrame, metric: str) -> DataFrame:
    """``cohort_id, id_a, id_b, people_a, people_b, dist`` with ``id_a < id_b``, in micro units.

    This is the distance matrix in compressed form: two people are as far apart as
    their profiles, and people of one profile are 0 apart.
    """
    distance = pair_metric(metric)
    left = prefixed(profiles, "a_", keep=("cohort_id", "peers"))
    right = prefixed(profiles, "b_", keep=("cohort_id", "peers"))
    pairs = pair_within(left, right, ["cohort_id"], ["a_profile_id"], "peers")
    return pairs.where("a_profile_id < b_profile_id").select(
        "cohort_id",
        F.col("a_profile_id").alias("id_a"),
        F.col("b_profile_id").alias("id_b"),
        F.col("a_weight").alias("people_a"),
        F.col("b_weight").alias("people_b"),
        distance("a_", "b_").alias("dist"),
    )
