"""How many groups a cohort gets, and the seeded first centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.operators.joins import join_by_weight
from evenfold.operators.profiles import SKILL_KEYS, attach_profiles
from evenfold.operators.ranking import rank_in_cohort


def check_group_size(size: int, mode: str = "generate") -> int:
    """The target size as a whole number in the range the mode allows."""
    if isinstance(size, bool) or not isinstance(size, int):
        raise ValueError(f"group size must be a whole number, not {size!r}")
    if mode == "generate" and size <= 0:
        raise ValueError("group size must be greater than 0")
    if mode == "evaluate" and not 2 <= size <= 100:
        raise ValueError("group size must lie between 2 and 100")
    return size


def group_config(people: DataFrame, size: int, mode: str = "generate", k: int | None = None) -> DataFrame:
    """``cohort_id, n, k``: people and number of clusters of each cohort.

    ``generate``: n div size, at least 1. ``evaluate``: n div size, at least 2, but
    never more clusters than people. An explicit ``k`` wins.
    """
    n = F.col("n")
    if k is not None:
        clusters = F.lit(k)
    elif mode == "generate":
        clusters = F.greatest(F.lit(1), F.floor(n / size))
    elif mode == "evaluate":
        clusters = F.least(F.greatest(F.lit(2), F.floor(n / size)), n)
    else:
        raise ValueError(f"mode must be 'generate' or 'evaluate', not {mode!r}")
    counts = people.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("cohort_id", "n", clusters.cast("bigint").alias("k"))


def check_clusters(config: DataFrame) -> None:
    """Every cohort needs at least one cluster and no more than it has people."""
    bad = config.where("k < 1 OR k > n").select("cohort_id", "n", "k").take(20)
    if bad:
        raise ValueError(f"number of clusters out of range for cohorts (id, n, k): {[tuple(r) for r in bad]}")


def draw_order(row_id: Column, seed: int) -> Column:
    """A fixed pseudo-random key of a row; the same in any engine and partitioning."""
    return F.pmod(F.pmod(row_id, F.lit(2**31)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(2**32))


def init_slots(people: DataFrame, config: DataFrame, seed: int = 42, extra: tuple[str, ...] = ()) -> DataFrame:
    """The first ``k`` people of each cohort in draw order: ``cohort_id, slot, row_id``."""
    drawn = people.select("cohort_id", "row_id", *extra, draw_order(F.col("row_id"), seed).alias("_draw"))
    ranked = rank_in_cohort(drawn, ["_draw", "row_id"], "_rank")
    chosen = join_by_weight(ranked, config, ["cohort_id"], "n").where("_rank <= k")
    return chosen.select("cohort_id", (F.col("_rank") - 1).cast("int").alias("slot"), "row_id", *extra)


def init_medoids(people: DataFrame, profiles: DataFrame, config: DataFrame, keys: tuple[str, ...] = SKILL_KEYS,
                 seed: int = 42) -> DataFrame:
    """First centres as profiles: ``cohort_id, slot, profile_id``."""
    slots = init_slots(people, config, seed, keys)
    return attach_profiles(slots, profiles, keys, ("profile_id",)).select("cohort_id", "slot", "profile_id")


def split_idle(slots: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The lowest ``keep`` slots of every profile, and the others.

    In a huge cohort many slots start on the same profile. A round moves at most one of them away
    and only the lowest can win anything, so a loop of r rounds never looks past the lowest r + 2 of
    them: the others stay as they are, whatever happens.
    """
    order = Window.partitionBy("cohort_id", "profile_id").orderBy("slot")
    ranked = slots.withColumn("_nth", F.row_number().over(order))
    return ranked.where(F.col("_nth") <= keep).drop("_nth"), ranked.where(F.col("_nth") > keep).drop("_nth")
