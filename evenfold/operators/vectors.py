"""K-Means and separation scores of any numeric vectors, not only of people's features.

Rows are ``cohort_id, row_id, vector``. Equal vectors of a cohort are one profile with a weight, so the
clustering and the scores of profiles serve here, too. The silhouette is the exception: long vectors have no
columns to subtract in code, so blocks of vectors are compared as matrices.

A null vector, a null or non-finite component, or another length than the cohort's other vectors is
an error that names the rows. An empty table gives empty results. Repeated vectors always get one label.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.functions.measure import MICRO, quantise
from evenfold.operators import lloyd, separation
from evenfold.operators.joins import join_by_weight
from evenfold.operators.seeding import check_clusters, group_config, init_slots
from evenfold.operators.reach import VECTOR
from evenfold.operators.separation import RUN
from evenfold.session import checkpoint, task_count


def _as_features(rows: DataFrame, vector: str) -> DataFrame:
    """``cohort_id, row_id, features`` with components as doubles and no negative zero."""
    return rows.select("cohort_id", "row_id", F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("features"))


def check_vectors(rows: DataFrame, vector: str = "vector") -> None:
    """Every vector must be whole, finite and as long as the longest of its cohort."""
    found = _as_features(rows, vector)
    width = found.groupBy("cohort_id").agg(F.max(F.size("features")).alias("_width"))
    broken = F.col("features").isNull() | (F.size("features") != F.col("_width")) | F.exists(
        "features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # One row per cohort on the right; adaptive execution splits hot cohorts.
    bad = found.join(width, "cohort_id").where(broken).select("cohort_id", "row_id").take(20)
    if bad:
        raise ValueError(f"unusable vectors (cohort, row): {[tuple(r) for r in bad]}")


def vector_profiles(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Distinct vectors of each cohort: ``profile_id`` (least row), ``weight``, ``features``, ``features_q``, ``peers``."""
    check_vectors(rows, vector)
    counted = checkpoint(_as_features(rows, vector).groupBy("cohort_id", "features").agg(
        F.count(F.lit(1)).alias("weight"), F.min("row_id").alias("profile_id")))
    peers = counted.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("peers"))
    return checkpoint(counted.join(peers, "cohort_id").withColumn("features_q", F.transform("features", quantise)))


def attach_vector_profiles(rows: DataFrame, profiles: DataFrame, vector: str = "vector") -> DataFrame:
    """``cohort_id, row_id, profile_id``; a vector that many rows share is spread over tasks."""
    small = profiles.select("cohort_id", "features", "weight", "profile_id")
    joined = join_by_weight(_as_features(rows, vector), small, ["cohort_id", "features"], "weight")
    return joined.select("cohort_id", "row_id", "profile_id")


def kmeans_vectors(rows: DataFrame, k: int, metric: str = "euclidean", vector: str = "vector", seed: int = 42,
                   max_iter: int = lloyd.MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``cohort_id, row_id, label`` and ``cohort_id, slot, centroid, rounds, converged`` with ``k`` clusters per cohort.

    Centroids are doubles, rounded to millionths.
    """
    config = group_config(rows, 1, k=k)
    check_clusters(config)
    profiles = vector_profiles(rows, vector)
    placed = checkpoint(attach_vector_profiles(rows, profiles, vector))
    slots = checkpoint(init_slots(placed, config, seed, ("profile_id",)).select("cohort_id", "slot", "profile_id"))
    labels, centroids = lloyd.kmeans_steered(profiles, slots, metric, max_iter)
    weighted = labels.join(profiles.select("cohort_id", "profile_id", "weight"), ["cohort_id", "profile_id"])
    named = join_by_weight(placed, weighted, ["cohort_id", "profile_id"], "weight").select(
        "cohort_id", "row_id", F.col("slot").alias("label"))
    return named, centroids.withColumn("centroid", F.transform("centroid", lambda x: x / F.lit(float(MICRO))))


# Vectors that are worth a task of their own as one side of the distances, and bytes of the largest such side.
BLOCK = 4_096
BLOCK_BYTES = 1 << 25


def silhouette_vectors(cells: DataFrame, profiles: DataFrame, block: int | None = None) -> DataFrame:
    """The silhouette of cells (``run, cohort_id, group_id, profile_id, people``) by the L2 distance of their vectors.

    Profiles and cells of a cohort are cut into blocks of about ``block``; a pair of blocks is one task's work, of
    which only sums per profile and group leave, so neither a cohort nor its pairs meet in one place. Every vector is shuffled once per
    block it meets: unless told, blocks are as large as ``BLOCK_BYTES`` allows, and smaller only to keep all tasks busy.
    """
    placed = separation._placed(cells, profiles)
    if block is not None:
        return separation._by_blocks(cells, placed, VECTOR, ("features",), block, block)
    width = profiles.agg(F.max(F.size("features"))).first()[0] or 1
    largest = max(BLOCK, BLOCK_BYTES // (8 * max(1, width)))
    # Pairs of blocks are dealt to tasks by a hash: about eight for each even out.
    side = math.ceil(math.sqrt(8 * task_count(cells.sparkSession)))
    return separation._by_blocks(cells, placed, VECTOR, ("features",), largest, largest, (BLOCK, side))


def separation_vectors(labelled: DataFrame, vector: str = "vector") -> DataFrame:
    """All three scores of labelled vectors (``run, cohort_id, row_id, group_id, vector``).

    A score is NULL with fewer than two groups, or with a group per row.
    """
    rows = labelled.select("run", "cohort_id", "row_id", F.col("group_id").cast("bigint").alias("group_id"), vector)
    distinct = rows.dropDuplicates(["cohort_id", "row_id"])
    profiles = vector_profiles(distinct, vector)
    placed = attach_vector_profiles(distinct, profiles, vector)
    cells = separation.group_profiles(rows.select("run", "cohort_id", "row_id", "group_id").join(placed, ["cohort_id", "row_id"]))
    scores, moments = separation.run_summary(cells), separation.group_moments(cells, profiles)
    for part in (silhouette_vectors(cells, profiles), separation.davies_bouldin(cells, profiles, moments),
                 separation.calinski_harabasz(cells, profiles, moments)):
        scores = scores.join(part, RUN)
    return scores
