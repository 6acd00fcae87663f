"""K-Means as rounds of DataFrame jobs, all cohorts at once.

Assignment uses L2 or L1; the update is the mean in both cases. Centroids are kept in micro
units. A cohort whose centroids stand still is settled and takes no part in later
rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.functions.measure import vector_metric
from evenfold.operators.joins import broadcast_if_small, pair_within
from evenfold.operators.seeding import split_idle
from evenfold.session import checkpoint, task_count

MAX_ROUNDS = 300
# Numbers in all centroids that a closure carries; more are kept in a table.
STEERED = 1 << 16


def start_centroids(profiles: DataFrame, slots: DataFrame) -> DataFrame:
    """``cohort_id, slot, centroid, peers`` from the profiles the slots start on."""
    return slots.join(
        profiles.select("cohort_id", "profile_id", "peers", F.col("features_q").alias("centroid")),
        ["cohort_id", "profile_id"],
    ).select("cohort_id", "slot", "centroid", "peers")


def assign(profiles: DataFrame, centroids: DataFrame, metric: str, centroid_rows: int | None = None) -> DataFrame:
    """``cohort_id, profile_id, slot``: nearest centroid, the lowest slot on a tie.

    Slots on one and the same centroid tie everywhere, so only the lowest is compared.
    """
    distance = vector_metric(metric)
    candidates = centroids.groupBy("cohort_id", "centroid", "peers").agg(F.min("slot").alias("slot"))
    if centroid_rows is not None:
        candidates = broadcast_if_small(candidates, centroid_rows)
    points = profiles.select("cohort_id", "profile_id", "features_q", "peers")
    pairs = pair_within(points, candidates, ["cohort_id"], ["profile_id"], "peers")
    nearest = F.min(F.struct(distance(F.col("features_q"), F.col("centroid")).alias("dist"), "slot"))
    return (
        pairs.groupBy("cohort_id", "profile_id").agg(nearest.alias("_best"))
        .select("cohort_id", "profile_id", F.col("_best.slot").alias("slot"))
    )


def update(profiles: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """New centroids, the old ones as ``before``: the mean of each slot's people.

    An empty slot keeps its centroid.
    """
    owned = profiles.select("cohort_id", "profile_id", "weight", "features_q").join(
        assigned, ["cohort_id", "profile_id"])
    means = weighted_means(owned, ["cohort_id", "slot"]).withColumnRenamed("mean_q", "_mean")
    return (
        centroids.join(means.drop("people"), ["cohort_id", "slot"], "left")
        .withColumn("before", F.col("centroid"))
        .withColumn("centroid", F.coalesce("_mean", "centroid"))
        .drop("_mean")
    )


def weighted_means(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, people, mean_q``: weighted mean vector in micro units."""
    long = points.select(*keys, "weight", F.posexplode("features_q").alias("_pos", "_value"))
    per_column = long.groupBy(*keys, "_pos").agg(
        F.sum(F.col("weight") * F.col("_value")).alias("_sum"), F.sum("weight").alias("_people"))
    mean = F.round(F.col("_sum") / F.col("_people")).cast("bigint")
    return per_column.groupBy(*keys).agg(
        F.max("_people").alias("people"),
        F.array_sort(F.collect_list(F.struct("_pos", mean.alias("_mean")))).alias("_vector"),
    ).select(*keys, "people", F.transform("_vector", lambda x: x["_mean"]).alias("mean_q"))


def kmeans(profiles: DataFrame, slots: DataFrame, metric: str = "euclidean",
           max_iter: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Labels per profile; final centroids with the ``rounds`` their cohort took and whether it ``converged``.

    One DataFrame job per round for all cohorts of any size; cohorts that have settled sit out. Rounds end
    when no centroid moves, which is when no label can change any more. If ``max_iter`` ends them
    first, the centroids are one update newer than the labels.
    """
    vector_metric(metric)
    used, idle = split_idle(slots, max_iter + 2)
    start = start_centroids(profiles, used)
    state = checkpoint(start.select("*", F.col("centroid").alias("before"), F.lit(True).alias("active"), F.lit(0).cast("bigint").alias("rounds"))
                       .repartition("cohort_id", "slot"))
    rows = state.count()
    for _ in range(max_iter):
        busy = state.where("active")
        current = busy.select("cohort_id", "slot", "centroid", "peers")
        moved = update(profiles, assign(profiles, current, metric, rows), current)
        fresh = moved.select("cohort_id", "slot", F.col("centroid").alias("_after"),
                             (F.col("centroid") != F.col("before")).alias("_moved"))
        restless = fresh.groupBy("cohort_id").agg(F.bool_or("_moved").alias("_busy"))
        state = checkpoint(
            state.join(fresh.drop("_moved"), ["cohort_id", "slot"], "left")
            .join(broadcast_if_small(restless, rows), "cohort_id", "left")
            .select("cohort_id", "slot", "peers",
                    F.when(F.col("active"), F.col("centroid")).otherwise(F.col("before")).alias("before"),
                    F.coalesce("_after", "centroid").alias("centroid"),
                    F.coalesce("_busy", F.lit(False)).alias("active"),
                    (F.col("rounds") + F.col("active").cast("bigint")).alias("rounds")))
        if state.where("active").isEmpty():
            break
    labels = assign(profiles, state.select("cohort_id", "slot", "peers", F.col("before").alias("centroid")), metric, rows)
    ended = state.groupBy("cohort_id").agg(F.max("rounds").alias("rounds"), F.bool_and(~F.col("active")).alias("converged"))
    final = state.select("cohort_id", "slot", "centroid").unionByName(
        start_centroids(profiles, idle).select("cohort_id", "slot", "centroid"))
    return labels, final.join(broadcast_if_small(ended, rows), "cohort_id")


Centers = dict[int, dict[int, list[int]]]


def kmeans_steered(profiles: DataFrame, slots: DataFrame, metric: str = "euclidean",
                   max_iter: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The same as ``kmeans`` for few centroids: they travel with the tasks, and a round is one job that sums up vectors.

    More than ``STEERED`` numbers in all centroids go the way of ``kmeans``.
    """
    vector_metric(metric)
    used, idle = split_idle(slots, max_iter + 2)
    start = checkpoint(start_centroids(profiles, used))
    if (start.agg(F.sum(F.size("centroid"))).first()[0] or 0) > STEERED:
        return kmeans(profiles, slots, metric, max_iter)
    spark = profiles.sparkSession
    points = checkpoint(profiles.select("cohort_id", "weight", "features_q").repartition(task_count(spark)))
    before: Centers = {}
    peers = {}
    for r in start.collect():
        before.setdefault(r["cohort_id"], {})[r["slot"]] = list(r["centroid"])
        peers[r["cohort_id"]] = r["peers"]
    after, rounds, active = dict(before), dict.fromkeys(before, 0), set(before)
    for _ in range(max_iter):
        if not active:
            break
        before = before | {c: after[c] for c in active}
        fresh = {c: dict(after[c]) for c in active}
        for r in _means(points, {c: after[c] for c in active}, metric).collect():
            fresh[r["cohort_id"]][r["slot"]] = list(r["mean_q"])
        rounds |= {c: rounds[c] + 1 for c in active}
        active = {c for c in active if fresh[c] != after[c]}
        after |= fresh
    schema = "cohort_id bigint, slot int, centroid array<bigint>, peers bigint"
    last = spark.createDataFrame([(c, s, x, peers[c]) for c, own in before.items() for s, x in own.items()], schema)
    labels = assign(profiles, last, metric, len(peers))
    ended = spark.createDataFrame([(c, n, c not in active) for c, n in rounds.items()], "cohort_id bigint, rounds bigint, converged boolean")
    final = spark.createDataFrame([(c, s, x) for c, own in after.items() for s, x in own.items()], "cohort_id bigint, slot int, centroid array<bigint>")
    final = final.unionByName(start_centroids(profiles, idle).select("cohort_id", "slot", "centroid"))
    return labels, final.join(F.broadcast(ended), "cohort_id")


def _means(points: DataFrame, centers: Centers, metric: str) -> DataFrame:
    """``cohort_id, slot, mean_q`` of the points nearest to each centre; slots without points are absent."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            whose = batch.column(0).to_numpy()
            for cohort in np.unique(whose).tolist():
                if cohort not in centers:
                    continue
                own = batch.filter(pc.equal(batch.column(0), cohort))
                vectors, weight = own.column(2), own.column(1).to_numpy()
                x = vectors.flatten().to_numpy().reshape(len(vectors), -1)
                names = sorted(centers[cohort])
                c = np.array([centers[cohort][s] for s in names], np.int64)
                dist = np.zeros((len(x), len(c)), np.int64 if metric == "manhattan" else np.float64)
                for k in range(x.shape[1]):  # term after term, as the expression adds them
                    gap = x[:, k, None] - c[None, :, k]
                    dist += np.abs(gap) if metric == "manhattan" else gap.astype(np.float64) ** 2
                if float(np.abs(x).max(initial=0)) * float(weight.sum()) > 4e18:
                    raise OverflowError(f"sums of cohort {cohort} leave 64 bits")
                near = dist.argmin(axis=1)
                for s in np.unique(near).tolist():
                    mine = near == s
                    people, total = sums.get((cohort, names[s]), (0, 0))
                    sums[cohort, names[s]] = (people + int(weight[mine].sum()), total + (x[mine] * weight[mine, None]).sum(axis=0))
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int32()),
                pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tolist() for v in sums.values()], pa.list_(pa.int64()))],
                names=["cohort_id", "slot", "people", "sums"])

    parts = points.select("cohort_id", "weight", "features_q").mapInArrow(add, "cohort_id bigint, slot int, people bigint, sums array<bigint>")
    long = parts.select("cohort_id", "slot", "people", F.posexplode("sums").alias("_pos", "_sum"))
    mean = F.round(F.sum("_sum") / F.sum("people")).cast("bigint")
    return long.groupBy("cohort_id", "slot", "_pos").agg(mean.alias("_mean")).groupBy("cohort_id", "slot").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_mean"))).alias("_vector")).select(
        "cohort_id", "slot", F.transform("_vector", lambda x: x["_mean"]).alias("mean_q"))
