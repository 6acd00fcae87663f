"""K-Medoids over profiles, all cohorts at once.

With n1, d1, d2 the nearest slot, its distance and the next distance of a profile,

    delta(s, c) = sum w * (min(d, d1) - d1)  +  sum over n1 = s of w * (min(d, d2) - min(d, d1))

and the swap taken is the smallest (slot, candidate) with a negative delta: the first
improvement a scan over slots and then over rows would meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.functions.measure import FAR, pair_metric
from evenfold.operators.given import PIECES, SLICES, pack, tile
from evenfold.operators.joins import broadcast_if_small, pair_within, prefixed, two_nearest
from evenfold.operators.seeding import split_idle
from evenfold.operators.swap_search import CENTER, LABEL, PAIR, POINT, SCHEMA, SEAT, search
from evenfold.session import BROADCAST_ROWS, checkpoint, shared_dir, slot_count, task_count

MAX_SWAPS = 200
# So many profiles of a cohort make one more share of its candidates.
SHARE_PROFILES = 1_024
# A cohort of so many shares stays whole: it would wait a second per swap for its shares to agree.
WHOLE_SHARES = 4
# Ids of a block: a tile of given distances has at most about its square of pairs.
TILE_IDS = 1_024
# Given pairs of a written file, which one task packs.
FILE_PAIRS = 1 << 21

# The columns of a profile each distance reads.
NEEDS = {
    "manhattan": ("Learning_Style", "q_motivation", "q_esteem", "q_ethic", "q_gap"),
    "euclidean": ("Learning_Style", "z_motivation", "z_esteem", "z_ethic", "z_gap"),
    "gower": ("Motivation", "Self_Esteem", "Work_Ethic", "Learning_Style", "Gender", "Diversity",
              "span_motivation", "span_esteem", "span_ethic"),
}


def signature(profiles: DataFrame, metric: str) -> DataFrame:
    """The columns a metric reads, and no others."""
    pair_metric(metric)
    return profiles.select("cohort_id", "profile_id", "weight", "peers", *NEEDS[metric])


def lowest_slots(medoids: DataFrame) -> DataFrame:
    """``cohort_id, profile_id, slot, spare``: the two lowest slots on each profile, however many it has."""
    order = Window.partitionBy("cohort_id", "profile_id").orderBy("slot")
    lowest = medoids.withColumn("_nth", F.row_number().over(order)).where("_nth <= 2")
    return lowest.groupBy("cohort_id", "profile_id").agg(
        F.min("slot").alias("slot"), F.max(F.when(F.col("_nth") == 2, F.col("slot"))).alias("spare"))


def occupied(points: DataFrame, medoids: DataFrame) -> DataFrame:
    """One row per distinct medoid profile: its lowest slot, the next one, its columns."""
    lowest = lowest_slots(medoids)
    return points.drop("weight").join(lowest, ["cohort_id", "profile_id"])


def nearest_medoids(points: DataFrame, medoids: DataFrame, metric: str, medoid_rows: int | None = None) -> DataFrame:
    """``points`` plus ``n1, d1, d2``; a tie goes to the lowest slot."""
    distance = pair_metric(metric)
    seats = prefixed(occupied(points, medoids), "b_", keep=("cohort_id", "peers"))
    if medoid_rows is not None:
        seats = broadcast_if_small(seats, medoid_rows)
    pairs = pair_within(prefixed(points, "a_", keep=("cohort_id", "peers")), seats,
                        ["cohort_id"], ["a_profile_id"], "peers")
    measured = pairs.select(
        "cohort_id", F.col("a_profile_id").alias("profile_id"), distance("a_", "b_").alias("dist"),
        F.struct(F.col("b_slot").alias("slot"), F.col("b_spare").isNull().alias("alone")).alias("seat"))
    ranked = two_nearest(measured, ["cohort_id", "profile_id"], "dist", "seat")
    second = F.coalesce("second_value", F.lit(FAR))
    return points.join(ranked, ["cohort_id", "profile_id"]).select(
        *points.columns,
        F.col("first_id.slot").alias("n1"),
        F.col("first_value").alias("d1"),
        F.when(F.col("first_id.alone"), second).otherwise(F.col("first_value")).alias("d2"),
    )


def medoid_assign(profiles: DataFrame, medoids: DataFrame, metric: str) -> DataFrame:
    """``cohort_id, profile_id, weight, slot, dist`` to the nearest medoid."""
    near = nearest_medoids(signature(profiles, metric), medoids, metric)
    return near.select("cohort_id", "profile_id", "weight", F.col("n1").alias("slot"), F.col("d1").alias("dist"))


def medoid_cost(assigned: DataFrame) -> DataFrame:
    """Summed distance of everybody to their medoid, per cohort."""
    return assigned.groupBy("cohort_id").agg(F.sum(F.col("weight") * F.col("dist")).alias("cost"))


def swap_parts(near: DataFrame, metric: str, near_rows: int | None = None) -> DataFrame:
    """``cohort_id, cand, slot, gain, own``: the two sums of a swap delta.

    ``gain`` is the first sum over all profiles of the cohort, ``own`` the second over
    those whose nearest slot is ``slot``.
    """
    distance = pair_metric(metric)
    carried = prefixed(near, "b_", keep=("cohort_id", "peers"))
    if near_rows is not None:
        carried = broadcast_if_small(carried, near_rows)
    candidates = prefixed(near.drop("weight", "n1", "d1", "d2"), "a_", keep=("cohort_id", "peers"))
    pairs = pair_within(candidates, carried, ["cohort_id"], ["a_profile_id"], "peers").select(
        "cohort_id", F.col("a_profile_id").alias("cand"), F.col("b_n1").alias("slot"),
        "b_weight", "b_d1", "b_d2", distance("a_", "b_").alias("_d"))
    closer = F.least("_d", "b_d1")
    parts = pairs.groupBy("cohort_id", "cand", "slot").agg(
        F.sum(F.col("b_weight") * (closer - F.col("b_d1"))).alias("_gain"),
        F.sum(F.col("b_weight") * (F.least("_d", "b_d2") - closer)).alias("own"),
    )
    whole = Window.partitionBy("cohort_id", "cand")
    return parts.select("cohort_id", "cand", "slot", F.sum("_gain").over(whole).alias("gain"), "own")


def swap_deltas(profiles: DataFrame, medoids: DataFrame, metric: str) -> DataFrame:
    """``cohort_id, slot, cand, delta`` for every slot and every candidate profile.

    A slot that shares its profile with a lower slot owns nobody, so its delta is the
    gain alone.
    """
    near = checkpoint(nearest_medoids(signature(profiles, metric), medoids, metric))
    parts = checkpoint(swap_parts(near, metric))
    gains = parts.select("cohort_id", "cand", "gain").distinct()
    grid = gains.join(medoids.select("cohort_id", "slot"), "cohort_id")
    return grid.join(parts.drop("gain"), ["cohort_id", "cand", "slot"], "left").select(
        "cohort_id", "slot", "cand", (F.col("gain") + F.coalesce("own", F.lit(0))).alias("delta"))


def _shares(peers: Column, tasks: int) -> Column:
    """How many tasks share the candidates of a cohort."""
    wanted = F.ceil(peers / F.lit(SHARE_PROFILES))
    return F.when(wanted <= WHOLE_SHARES, 1).otherwise(F.least(F.lit(tasks), F.greatest(F.lit(1), wanted))).cast("int")


def _solved(points: DataFrame, slots: DataFrame, metric: str | None, max_iter: int, distances: DataFrame | None = None) -> DataFrame:
    """``cohort_id, kind, slot, profile_id, swaps, converged``: labels of all points and final medoids.

    Points carry ``peers``, and with ``distances``, the slices of the matrix, their block ``part``. Of slots on one profile only the lowest ``max_iter + 2`` can come into
    play, as a swap moves one of them at most; the others stay where they are and are added to the result.
    """
    tasks = slot_count(points.sparkSession)
    busy, idle = split_idle(slots.select("cohort_id", "slot", "profile_id"), max_iter + 2)
    sizes = points.groupBy("cohort_id").agg(_shares(F.max("peers"), tasks).alias("shares"))
    own = F.pmod(F.xxhash64("profile_id"), _shares(F.col("peers"), tasks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    columns = [c for c in points.columns if c not in ("cohort_id", "profile_id", "weight", "peers")]
    rows = points.select(F.lit(POINT).alias("kind"), "cohort_id", _shares(F.col("peers"), tasks).alias("shares"), "profile_id", "weight",
                         own.alias("own"), *columns).select("*", every)
    seats = busy.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "cohort_id").select(
        F.lit(SEAT).alias("kind"), "cohort_id", "shares", "profile_id", "slot").select("*", every)
    dealt = rows.unionByName(seats, allowMissingColumns=True)
    if distances is not None:
        pairs = distances.join(sizes, "cohort_id").select(
            F.lit(PAIR).alias("kind"), "cohort_id", "shares", F.col("id").alias("profile_id"), "part", "dist",
            F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
        dealt = dealt.unionByName(pairs, allowMissingColumns=True)
    # The pieces of a cohort have to meet in the task of their share; its candidates are what is split.
    dealt = dealt.fillna(0, ["weight", "own", "slot", *(["part"] if distances is not None else [])])
    dealt = dealt.repartition(tasks, "cohort_id", "share").sortWithinPartitions("cohort_id", "share")

    def run(batches):
        return search(batches, metric, max_iter)

    solved = checkpoint(dealt.mapInArrow(run, SCHEMA, barrier=True))
    state = solved.groupBy("cohort_id").agg(F.max("swaps").alias("swaps"), F.bool_and("converged").alias("converged"))
    rest = idle.join(state, "cohort_id").select("cohort_id", F.lit(CENTER).alias("kind"), "slot", "profile_id", "swaps", "converged")
    return solved.unionByName(rest)


def kmedoids(profiles: DataFrame, slots: DataFrame, metric: str = "manhattan",
             max_iter: int = MAX_SWAPS) -> tuple[DataFrame, DataFrame]:
    """Labels per profile, and final medoids after at most ``max_iter`` swaps per cohort.

    Medoids also tell how many ``swaps`` their cohort made and whether it ``converged`` before the limit.
    """
    return _split(_solved(signature(profiles, metric), slots, metric, max_iter))


def _split(solved: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (solved.where(F.col("kind") == LABEL).select("cohort_id", "profile_id", "slot"),
            solved.where(F.col("kind") == CENTER).select("cohort_id", "slot", "profile_id", "swaps", "converged"))


def both_ways(distances: DataFrame) -> DataFrame:
    """Both directions of a table that has each pair once or twice, as slices: ``cohort_id, id, own, part, dist``.

    ``dist`` has the distances (64-bit numbers) of ``id``, whose block is ``own``, to the ids of block ``part`` in ascending order. Every pair goes
    through one shuffle, once. A pair given twice needs equal distances, and every pair of a cohort's ids has to be there: cohorts for which this
    does not hold raise an error. Rows of an id with itself only name the id.
    """
    spark = distances.sparkSession
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    distances.select(F.col("cohort_id").cast("bigint"), F.least("id_a", "id_b").cast("bigint").alias("id_a"), F.greatest("id_a", "id_b").cast("bigint").alias("id_b"),
                     F.col("dist").cast("bigint").alias("dist")).write.option("maxRecordsPerFile", FILE_PAIRS).parquet(path)
    given = spark.read.schema("cohort_id bigint, id_a bigint, id_b bigint, dist bigint").parquet(path)
    # One row per cohort. With n ids it has n * n / 2 rows, or a few times that, which only makes blocks smaller.
    sizes = checkpoint(given.where("cohort_id IS NOT NULL").groupBy("cohort_id").agg(
        F.ceil(F.sqrt(2 * F.count(F.lit(1))) / F.lit(TILE_IDS)).cast("int").alias("_blocks"), F.count_if(F.col("id_a").isNull()).alias("_void")))
    # At most pairs / (TILE_IDS * TILE_IDS / 2) cohorts.
    many = {r[0]: r[1] for r in sizes.where("_blocks > 1").select("cohort_id", "_blocks").collect()}

    def packed(batches):
        return pack(batches, many)

    # Files travel whole: Spark would need microseconds to hand a single pair to Python.
    pieces = spark.read.format("binaryFile").load(path).select("content").mapInArrow(packed, PIECES)
    keys = ["cohort_id", "_i", "_j"]
    tiles = checkpoint(pieces.repartition(task_count(spark), *keys).groupBy(*keys).applyInArrow(tile, SLICES))
    ids = tiles.select("cohort_id", "id").distinct().groupBy("cohort_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = tiles.groupBy("cohort_id").agg(F.sum("pairs").alias("pairs"), F.sum("bad").alias("bad"))
    wrong = sizes.join(ids, "cohort_id", "left").join(pairs, "cohort_id", "left").where("2 * pairs <> n * (n - 1) OR bad > 0 OR _void > 0").select(
        "cohort_id", "n", "pairs", F.expr("coalesce(bad, 0) + _void").alias("bad")).take(20)
    if wrong:
        raise ValueError(f"distances are missing, null, negative or contradict each other in cohorts (id, ids, pairs, bad): {[tuple(r) for r in wrong]}")
    return tiles.drop("pairs", "bad")


def kmedoids_given(distances: DataFrame, slots: DataFrame, max_iter: int = MAX_SWAPS) -> tuple[DataFrame, DataFrame]:
    """K-Medoids on a table of distances (``cohort_id, id_a, id_b, dist``), whole numbers, each pair once.

    ``slots`` has ``cohort_id, slot, row_id``. Labels are ``cohort_id, row_id, slot``; medoids as in ``kmedoids``.
    """
    table = both_ways(distances)
    points = table.groupBy("cohort_id", F.col("id").alias("profile_id")).agg(F.lit(1).cast("bigint").alias("weight"), F.min("own").alias("part"))
    peers = points.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("peers"))
    labels, medoids = _split(_solved(points.join(peers, "cohort_id"), slots.withColumnRenamed("row_id", "profile_id"), None, max_iter, table))
    return labels.withColumnRenamed("profile_id", "row_id"), medoids.withColumnRenamed("profile_id", "row_id")
