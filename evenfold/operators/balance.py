"""Who is in each group: sizes, category counts, entropies, skill variances, members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.operators.ranking import rank_in_cohort

# Fixed value: keeps the logarithm of an entropy finite.
TINY = 1e-10
KEYS = ["run", "cohort_id", "group_id"]
# Skill columns in the order their variances are listed.
SKILLS = {"Motivation": "motivation_variance", "Work_Ethic": "work_ethic_variance", "Self_Esteem": "self_esteem_variance"}


def as_run(labelled: DataFrame, run: str) -> DataFrame:
    """Name a labelling, so that several can be scored in one pass."""
    return labelled.withColumn("run", F.lit(run))


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size"))


def breakdown(labelled: DataFrame, column: str) -> DataFrame:
    """People per group and category; missing categories are not counted."""
    return labelled.where(F.col(column).isNotNull()).groupBy(*KEYS, F.col(column).alias("category")).agg(
        F.count(F.lit(1)).alias("n"))


def cluster_entropy(labelled: DataFrame) -> DataFrame:
    """``run, cohort_id, group_id, size, gender_entropy, diversity_entropy``.

    -sum p ln(p + 1e-10) with p of the whole group, people without a category included. One
    count per (group, gender, diversity) feeds both entropies. A column that is absent
    scores 0.
    """
    cells = labelled
    for column in ("Gender", "Diversity"):
        if column not in labelled.columns:
            cells = cells.withColumn(column, F.lit(None).cast("string"))
    cells = cells.groupBy(*KEYS, "Gender", "Diversity").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(*KEYS).agg(F.sum("n").alias("size"))
    out = sizes
    for column, name in (("Gender", "gender_entropy"), ("Diversity", "diversity_entropy")):
        counts = cells.where(F.col(column).isNotNull()).groupBy(*KEYS, column).agg(F.sum("n").alias("n"))
        p = F.col("n") / F.col("size")
        term = counts.join(sizes, KEYS).groupBy(*KEYS).agg(F.sum(-p * F.ln(p + TINY)).alias(name))
        out = out.join(term, KEYS, "left")
    return out.select(*KEYS, "size", F.coalesce("gender_entropy", F.lit(0.0)).alias("gender_entropy"),
                      F.coalesce("diversity_entropy", F.lit(0.0)).alias("diversity_entropy"))


def mean_entropy(entropies: DataFrame) -> DataFrame:
    """Unweighted mean over groups; higher is better balanced."""
    return entropies.groupBy("run", "cohort_id").agg(
        F.avg("gender_entropy").alias("mean_gender_entropy"),
        F.avg("diversity_entropy").alias("mean_diversity_entropy"))


def _group_variances(labelled: DataFrame) -> DataFrame:
    missing = [c for c in SKILLS if c not in labelled.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    raw = labelled.groupBy(*KEYS).agg(*[F.var_samp(c).alias(name) for c, name in SKILLS.items()])
    names = list(SKILLS.values())
    return raw.withColumn("_mean", (F.col(names[0]) + F.col(names[1]) + F.col(names[2])) / 3)


def skill_variance_by_cluster(labelled: DataFrame) -> DataFrame:
    """Sample variance of each score per group and their mean; a group of one shows 0."""
    return _group_variances(labelled).select(
        *KEYS, *[F.coalesce(name, F.lit(0.0)).alias(name) for name in SKILLS.values()],
        F.coalesce("_mean", F.lit(0.0)).alias("mean_skill_variance"))


def skill_variance_overall(labelled: DataFrame) -> DataFrame:
    """Mean and population deviation of the groups' mean variances, per run and cohort.

    One group of one makes both NaN; ``overall_mean_variance_nonsingleton`` leaves such groups out.
    """
    lone = F.bool_or(F.col("_mean").isNull())
    nan = F.lit(float("nan"))
    return _group_variances(labelled).groupBy("run", "cohort_id").agg(
        F.when(lone, nan).otherwise(F.avg("_mean")).alias("overall_mean_variance"),
        F.when(lone, nan).otherwise(F.stddev_pop("_mean")).alias("overall_std_variance"),
        F.avg("_mean").alias("overall_mean_variance_nonsingleton"),
    )


def cluster_balance(labelled: DataFrame) -> DataFrame:
    """One row per run and group: size, entropies and skill variances side by side."""
    return cluster_entropy(labelled).join(skill_variance_by_cluster(labelled), KEYS)


def group_members(labelled: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``cohort_id, group_id, position, Name``: the members of each group in row order, from 1.

    ``groups`` (``cohort_id, k``) lists groups 0 .. k-1; an empty one shows as position 0
    without a name. One row per member, because a group may be far too long for an array.
    """
    rows = labelled.select("cohort_id", "group_id", "row_id", "Name")
    listed = rank_in_cohort(rows, ["row_id"], "position", ("cohort_id", "group_id")).select(
        "cohort_id", "group_id", "position", "Name")
    if groups is None:
        return listed
    every = groups.select("cohort_id", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("group_id"))
    used = listed.select("cohort_id", "group_id").distinct()
    empty = every.join(used, ["cohort_id", "group_id"], "left_anti").select(
        "*", F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("string").alias("Name"))
    return listed.unionByName(empty)
