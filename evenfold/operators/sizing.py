"""Equal group sizes: chunk a cohort in label order, then place the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.functions.measure import vector_metric
from evenfold.operators.joins import join_by_weight, pair_within
from evenfold.operators.lloyd import weighted_means
from evenfold.operators.ranking import rank_in_cohort
from evenfold.session import checkpoint


COHORT = ("cohort_id",)


def core_groups(labels: DataFrame, size: int, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """``labels`` plus ``rn``, ``n_groups`` and ``group_id``.

    ``keys`` name one labelling; with a run in front of the cohort several are sized at once.

    Rows are numbered by (label, row_id); every full run of ``size`` rows is a group. The
    rows behind the last full run get NULL. A cohort under ``size`` is group 0.
    """
    ranked = rank_in_cohort(labels, ["label", "row_id"], by=keys)
    counts = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("n_groups", F.floor(F.col("_n") / size))
    sized = join_by_weight(ranked, counts, list(keys), "_n")
    group = (
        F.when(F.col("n_groups") == 0, F.lit(0))
        .when(F.col("rn") <= F.col("n_groups") * size, F.floor((F.col("rn") - 1) / size))
    )
    return sized.withColumn("group_id", group.cast("int")).drop("_n")


def group_centers(core: DataFrame, profiles: DataFrame, keys: tuple[str, ...] = COHORT) -> DataFrame:
    """``keys, group_id, people, mean_q`` of the placed rows."""
    cells = core.where("group_id IS NOT NULL").groupBy(*keys, "group_id", "profile_id").agg(
        F.count(F.lit(1)).alias("weight"))
    points = join_by_weight(cells, profiles.select("cohort_id", "profile_id", "features_q", F.col("weight").alias("_w")),
                            ["cohort_id", "profile_id"], "_w", spread="group_id")
    return weighted_means(points, [*keys, "group_id"])


def nearest_center(left_over: DataFrame, centers: DataFrame, profiles: DataFrame, metric: str,
                   keys: tuple[str, ...] = COHORT) -> DataFrame:
    """``keys, profile_id, group_id``: nearest centre, the lowest group on a tie."""
    distance = vector_metric(metric)
    wanted = left_over.select(*keys, "profile_id", "n_groups").distinct().join(
        profiles.select("cohort_id", "profile_id", "features_q"), ["cohort_id", "profile_id"])
    placed = centers.join(left_over.select(*keys, "n_groups").distinct(), list(keys)).select(
        *keys, "n_groups", "group_id", "mean_q")
    pairs = pair_within(placed, wanted, list(keys), ["group_id"], "n_groups")
    nearest = F.min(F.struct(distance(F.col("features_q"), F.col("mean_q")).alias("dist"), "group_id"))
    return pairs.groupBy(*keys, "profile_id").agg(nearest.alias("_best")).select(
        *keys, "profile_id", F.col("_best.group_id").alias("group_id"))


def smart_fill(core: DataFrame, profiles: DataFrame, metric: str = "manhattan",
               keys: tuple[str, ...] = COHORT) -> DataFrame:
    """Place each left-over row in the group with the nearest centre.

    Centres are those of the full groups and stay fixed, so one group may take
    several rows. There are fewer left-over rows than ``size`` in a cohort.
    """
    left_over = core.where("group_id IS NULL").drop("group_id")
    nearest = nearest_center(left_over, group_centers(core, profiles, keys), profiles, metric, keys)
    return left_over.join(nearest, [*keys, "profile_id"])


def round_robin_fill(core: DataFrame, size: int) -> DataFrame:
    """Deal the left-over rows to groups 0, 1, 2, ... in order."""
    turn = F.col("rn") - 1 - F.col("n_groups") * size
    return core.where("group_id IS NULL").withColumn("group_id", F.pmod(turn, F.col("n_groups")).cast("int"))


def enforce_group_size(labels: DataFrame, size: int, profiles: DataFrame | None = None,
                       metric: str = "manhattan", keys: tuple[str, ...] = COHORT) -> DataFrame:
    """``labels`` (with ``label``) regrouped into ``n div size`` groups as ``group_id``.

    With ``profiles`` the left-over rows go to the nearest centre, without in turn.
    """
    core = checkpoint(core_groups(labels, size, keys))
    rest = round_robin_fill(core, size) if profiles is None else smart_fill(core, profiles, metric, keys)
    columns = [*labels.columns, "group_id"]
    return core.where("group_id IS NOT NULL").select(*columns).unionByName(rest.select(*columns))
