"""Scores of one or several labellings, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.operators.balance import cluster_entropy, mean_entropy
from evenfold.operators.profiles import FULL_KEYS, attach_profiles, encode
from evenfold.operators.separation import (
    calinski_harabasz, davies_bouldin, group_moments, group_profiles, run_summary, silhouette,
)

# The runs of the tournament as algorithm and metric names.
RUNS = {
    "kmeans_euclidean": ("K-Means", "Euclidean"),
    "kmeans_manhattan": ("K-Means", "Manhattan"),
    "kmedoids_manhattan": ("K-Medoids", "Manhattan"),
    "kmedoids_gower": ("K-Medoids", "Gower"),
}
RUN = ["run", "cohort_id"]


def gower_cells(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and profiles over all six attributes, which the Gower distance reads."""
    full = encode(labelled.drop("profile_id").dropDuplicates(["cohort_id", "row_id"]), FULL_KEYS)
    rows = attach_profiles(labelled.drop("profile_id"), full, FULL_KEYS)
    return group_profiles(rows), full


def evaluate_runs(labelled: DataFrame, profiles: DataFrame, gower_runs: tuple[str, ...] = ()) -> DataFrame:
    """``run, cohort_id, n_samples, n_clusters, silhouette, davies_bouldin, calinski_harabasz,
    mean_gender_entropy`` of labelled people with a ``run`` column.

    The silhouette is Euclidean whatever distance made the groups, except for ``gower_runs``.
    """
    cells = group_profiles(labelled.select(*RUN, "group_id", "profile_id"))
    plain = cells.where(~F.col("run").isin(*gower_runs)) if gower_runs else cells
    scores = silhouette(plain, profiles, "euclidean")
    if gower_runs:
        special, full = gower_cells(labelled.where(F.col("run").isin(*gower_runs)))
        scores = scores.unionByName(silhouette(special, full, "gower"))
    moments = group_moments(cells, profiles)
    entropies = mean_entropy(cluster_entropy(labelled)).select(*RUN, "mean_gender_entropy")
    return (
        run_summary(cells)
        .join(scores, RUN)
        .join(davies_bouldin(cells, profiles, moments), RUN)
        .join(calinski_harabasz(cells, profiles, moments), RUN)
        .join(entropies, RUN)
    )


def named_runs(evaluated: DataFrame) -> DataFrame:
    """Add the ``algorithm`` and ``metric`` names of the runs."""
    algorithm, metric = F.col("run"), F.lit(None).cast("string")
    for run, (a, m) in RUNS.items():
        algorithm = F.when(F.col("run") == run, F.lit(a)).otherwise(algorithm)
        metric = F.when(F.col("run") == run, F.lit(m)).otherwise(metric)
    return evaluated.withColumns({"algorithm": algorithm, "metric": metric})


def comparison_table(evaluated: DataFrame) -> DataFrame:
    """The scores as text, one row per cohort, algorithm and metric."""
    def text(pattern: str, name: str):
        return F.when(F.col(name).isNotNull(), F.format_string(pattern, F.col(name)))

    return named_runs(evaluated).select(
        "cohort_id",
        F.col("algorithm").alias("Algorithm"),
        F.col("metric").alias("Metric"),
        F.col("n_clusters").alias("N Clusters"),
        text("%.4f", "silhouette").alias("Silhouette Score"),
        text("%.4f", "davies_bouldin").alias("Davies-Bouldin"),
        text("%.2f", "calinski_harabasz").alias("Calinski-Harabasz"),
        text("%.4f", "mean_gender_entropy").alias("Gender Balance (Mean Entropy)"),
    )


def best_run(evaluated: DataFrame) -> DataFrame:
    """The run with the highest silhouette of each cohort; both NULL where no run has one."""
    score = F.when(F.col("silhouette").isNotNull(), F.struct("silhouette", "run"))
    best = evaluated.groupBy("cohort_id").agg(F.max(score).alias("_best"))
    return best.select("cohort_id", F.col("_best.run").alias("run"), F.col("_best.silhouette").alias("best_silhouette"))


def rating_bands(evaluated: DataFrame) -> DataFrame:
    """Words for the scores: silhouette, Davies-Bouldin and skill variance where present."""
    out = evaluated
    for name, first, second, lower_is_better in (
        ("silhouette", 0.5, 0.0, False),
        ("davies_bouldin", 1.5, 2.0, True),
        ("mean_skill_variance", 0.3, 0.5, True),
    ):
        if name not in evaluated.columns:
            continue
        value = F.col(name)
        good, fair = (value < first, value < second) if lower_is_better else (value > first, value > second)
        band = F.when(value.isNull(), None).when(good, F.lit("good")).when(fair, F.lit("fair")).otherwise(F.lit("poor"))
        out = out.withColumn(f"{name}_band", band)
    return out
