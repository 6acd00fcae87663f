from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenfold.operators import lloyd, medoids, projection, seeding, swap_search
from evenfold.operators.joins import join_by_weight
from evenfold.operators.profiles import FULL_KEYS, SKILL_KEYS, encode
from evenfold.operators.ranking import rank_in_cohort
from evenfold.plans.cohorts import prepare
from evenfold.sources.learners import learners
from tests.kernels import CENTER, LABEL, distance_matrix, plain_kmeans, plain_kmedoids
from tests.conftest import SMALL, plain


@pytest.fixture(scope="module")
def small(spark):
    cohorts = prepare(learners(spark, SMALL))
    config = seeding.group_config(cohorts.people, 3)
    slots = seeding.init_medoids(cohorts.people, cohorts.profiles, config).cache()
    return cohorts, slots


def rows(df):
    return sorted(map(tuple, df.collect()))


def scan(matrix, weight, at, cap):
    """First-improvement swaps by trying every slot and row in turn."""
    at = list(at)
    for _ in range(cap):
        cost = (weight * matrix[:, at].min(axis=1)).sum()
        for slot, candidate in itertools.product(range(len(at)), range(len(matrix))):
            trial = [*at[:slot], candidate, *at[slot + 1:]]
            if candidate not in at and (weight * matrix[:, trial].min(axis=1)).sum() < cost:
                at = trial
                break
        else:
            break
    return at


@pytest.mark.parametrize("metric", ["manhattan", "gower"])
def test_swaps_match_a_plain_scan(small, metric):
    cohorts, slots = small
    profiles = cohorts.profiles
    if metric == "gower":
        profiles = encode(cohorts.people.drop("profile_id"), FULL_KEYS)
        config = seeding.group_config(cohorts.people, 3)
        slots = seeding.init_medoids(cohorts.people, profiles, config, FULL_KEYS)
    _, found = medoids.kmedoids(profiles, slots, metric)
    found = {(r.cohort_id, r.slot): r.profile_id for r in found.collect()}
    points = profiles.toPandas().sort_values("profile_id")
    seats = slots.toPandas().sort_values("slot")
    for cohort, group in points.groupby("cohort_id"):
        ids = group["profile_id"].to_numpy()
        start = np.searchsorted(ids, seats[seats.cohort_id == cohort]["profile_id"])
        expected = scan(distance_matrix(group, metric), group["weight"].to_numpy(), start, 200)
        assert [found[cohort, s] for s in range(len(expected))] == list(ids[expected])


def labels_of(plain, kind, column):
    chosen = plain[plain.kind == kind]
    return sorted((int(r.cohort_id), int(r.profile_id), int(r.slot)) if column == "label" else
                  (int(r.cohort_id), int(r.slot), tuple(r.centroid) if column == "centroid" else int(r.profile_id)) for r in chosen.itertuples())


def test_swap_jobs_match_a_plain_scan(small):
    cohorts, slots = small
    plain = plain_kmedoids(cohorts.profiles, slots, "manhattan", 3)
    labels, medoid = medoids.kmedoids(cohorts.profiles, slots, "manhattan", 3)
    assert sorted((r.cohort_id, r.profile_id, r.slot) for r in labels.collect()) == labels_of(plain, LABEL, "label")
    assert sorted((r.cohort_id, r.slot, r.profile_id) for r in medoid.collect()) == labels_of(plain, CENTER, "medoid")


@pytest.mark.parametrize("metric", ["manhattan", "euclidean", "gower"])
def test_shares_of_one_cohort_agree(spark, monkeypatch, metric):
    """Everybody in one cohort whose candidates are dealt to several tasks, against the plain loop."""
    people = learners(spark, "/root/testdata/sf0.01").withColumn("row_id", F.col("cohort_id") * 1_000 + F.col("row_id")).withColumn("cohort_id", F.lit(1).cast("bigint"))
    keys = FULL_KEYS if metric == "gower" else SKILL_KEYS
    cohorts = prepare(people.where("row_id % 3 = 0") if metric == "gower" else people, keys)
    slots = seeding.init_medoids(cohorts.people, cohorts.profiles, seeding.group_config(cohorts.people, 1, k=12), keys).cache()
    monkeypatch.setattr(medoids, "SHARE_PROFILES", 40)
    plain = plain_kmedoids(cohorts.profiles, slots, metric, 200)
    labels, medoid = medoids.kmedoids(cohorts.profiles, slots, metric)
    found = medoid.collect()
    assert sorted((r.cohort_id, r.profile_id, r.slot) for r in labels.collect()) == labels_of(plain, LABEL, "label")
    assert sorted((r.cohort_id, r.slot, r.profile_id) for r in found) == labels_of(plain, CENTER, "medoid")
    assert {r.converged for r in found} == {True} and found[0].swaps > 3
    _, cut = medoids.kmedoids(cohorts.profiles, slots, metric, 2)
    assert {(r.swaps, r.converged) for r in cut.collect()} == {(2, False)}


def _share(n: int, slots: int, seed: int):
    """A share that has a cohort of n profiles to itself, with slots on random profiles."""
    rng = np.random.default_rng(seed)
    points = pd.DataFrame({c: rng.integers(0, 4, n) for c in ("Motivation", "Self_Esteem", "Work_Ethic", "Learning_Style", "Gender", "Diversity")})
    points = points.assign(kind=swap_search.POINT, profile_id=np.arange(n), weight=rng.integers(1, 9, n), slot=0, own=0, span_motivation=3, span_esteem=3, span_ethic=3)
    seats = pd.DataFrame({"kind": swap_search.SEAT, "profile_id": rng.integers(0, n, slots), "slot": np.arange(slots)})
    return swap_search.Share(pd.concat([points, seats]).assign(cohort_id=1, share=0, shares=1), "gower", 200)


def test_kept_sums_stay_those_of_all_profiles():
    share, asked = _share(150, 30, 5), []
    share.start()
    between = share.far.between
    share.far.between = lambda a, b: asked.append(len(a) * len(b)) or between(a, b)
    best = share.best()
    asked.clear()
    while best and share.swaps < 20:
        share.swap(*best)
        best = share.best()
        gain, used, loss = share._sums(share.everybody, share.kept)
        assert np.array_equal(share.gain, gain) and np.array_equal(share.loss[share.line[used]], loss)
        assert sorted(np.flatnonzero(share.line >= 0)) == sorted(used)
    assert share.swaps == 20 and sum(asked) < 20 * 150 * 30


def test_slots_on_few_profiles_are_not_all_looked_at():
    share, widest = _share(12, 5_000, 6), []
    between = share.far.between
    share.far.between = lambda a, b: widest.append(len(b)) or between(a, b)
    share.start()
    assert max(widest) <= 24
    reach = between(share.everybody, share.at)
    first, order = reach.argmin(axis=1), np.argsort(reach, axis=1, kind="stable")
    assert np.array_equal(share.n1, first) and np.array_equal(share.n2, order[:, 1]) and np.array_equal(share.d2, np.sort(reach, axis=1)[:, 1])


@pytest.mark.parametrize("peers, shares", [(0, 1), (2_880, 1), (4_096, 1), (4_097, 5), (90_000, 8)])
def test_cohorts_of_a_few_thousand_profiles_stay_whole(spark, peers, shares):
    assert spark.range(1).select(medoids._shares(F.lit(peers), 8)).first()[0] == shares


def test_given_distances(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, matrices, seats = [], {}, []
    for cohort, n in ((1, 40), (2, 9), (3, 2)):
        d = rng.integers(1, 30, (n, n))
        d = np.triu(d, 1) + np.triu(d, 1).T
        matrices[cohort] = d
        rows += [(cohort, 10 * j, 10 * i, int(d[i, j])) for i in range(n) for j in range(i)]
        seats += [(cohort, s, 10 * s) for s in range(min(4, n))]
    table = spark.createDataFrame(rows, "cohort_id bigint, id_a bigint, id_b bigint, dist bigint")
    slots = spark.createDataFrame(seats, "cohort_id bigint, slot int, row_id bigint")
    for share in (1024, 5):
        monkeypatch.setattr(medoids, "SHARE_PROFILES", share)
        labels, found = medoids.kmedoids_given(table.repartition(3), slots)
        at = {(r.cohort_id, r.slot): r.row_id for r in found.collect()}
        for cohort, d in matrices.items():
            expected = scan(d, np.ones(len(d), int), list(range(min(4, len(d)))), 200)
            assert [at[cohort, s] for s in range(len(expected))] == [10 * x for x in expected]
            near = d[:, expected].argmin(axis=1)
            assert {(r.row_id, r.slot) for r in labels.where(F.col("cohort_id") == cohort).collect()} == {(10 * i, int(s)) for i, s in enumerate(near)}
    start, _ = medoids.kmedoids_given(table, slots, 0)
    assert start.count() == 51


@pytest.mark.parametrize("broken", ["id_a <> 10 OR id_b <> 0", "contradiction", "null", "negative"])
def test_given_distances_are_checked(spark, broken):
    rows = [(1, i, j, 5) for i in (0, 10, 20) for j in (0, 10, 20) if i > j]
    table = spark.createDataFrame(rows, "cohort_id bigint, id_a bigint, id_b bigint, dist bigint")
    extra = {"contradiction": (1, 0, 10, 6), "null": (1, 0, 10, None), "negative": (1, 30, 30, -1)}
    table = table.where(broken) if broken not in extra else table.union(spark.createDataFrame([extra[broken]], table.schema))
    with pytest.raises(ValueError, match="cohorts"):
        medoids.both_ways(table)


def test_given_distances_become_few_slices(spark, monkeypatch):
    monkeypatch.setattr(medoids, "TILE_IDS", 16)
    d = np.random.default_rng(5).integers(1, 1 << 40, (40, 40))
    d = np.triu(d, 1) + np.triu(d, 1).T
    rows = [(1, 7 * i, 7 * j, int(d[i, j])) for i in range(40) for j in range(i)] + [(1, 0, 7, int(d[0, 1])), (2, 5, 5, 0)]
    found = medoids.both_ways(spark.createDataFrame(rows, "cohort_id bigint, id_a bigint, id_b bigint, dist bigint")).collect()
    # One row per id and block, not one per direction of a pair.
    assert len(found) <= 40 * 3 + 1
    assert [np.frombuffer(r.dist, np.int64).tolist() for r in found if r.cohort_id == 2] == [[0]]
    blocks = np.array([next(r.own for r in found if r.cohort_id == 1 and r.id == 7 * i) for i in range(40)])
    for r in found:
        if r.cohort_id == 1:
            assert np.frombuffer(r.dist, np.int64).tolist() == d[r.id // 7, blocks == r.part].tolist()


def test_many_slots_on_one_profile_all_come_back(spark, people):
    cohorts = prepare(people([*[(i, "Male", 1.0, 1.0, 1.0, "Visual", "X") for i in range(9)], (9, "Male", 4.0, 4.0, 4.0, "Visual", "X")]))
    slots = spark.createDataFrame([(1, s, 0) for s in range(8)], "cohort_id bigint, slot int, profile_id bigint")
    _, found = medoids.kmedoids(cohorts.profiles, slots, "manhattan", 2)
    assert sorted((r.slot, r.profile_id) for r in found.collect()) == [(0, 9), *[(s, 0) for s in range(1, 8)]]
    _, centers = lloyd.kmeans(cohorts.profiles, slots, "euclidean", 2)
    assert centers.count() == 8


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_mean_jobs_match_a_plain_loop(small, metric):
    cohorts, slots = small
    plain = plain_kmeans(cohorts.profiles, slots, metric, 3)
    labels, centers = lloyd.kmeans(cohorts.profiles, slots, metric, 3)
    assert sorted((r.cohort_id, r.profile_id, r.slot) for r in labels.collect()) == labels_of(plain, LABEL, "label")
    assert sorted((r.cohort_id, r.slot, tuple(r.centroid)) for r in centers.collect()) == labels_of(plain, CENTER, "centroid")


def test_centroids_tell_whether_rounds_ended_by_themselves(spark, people):
    ends = [(i, "Male", float(x), 1.0, 1.0, "Visual", "X") for i, x in enumerate([0, 1, 2, 30, 31, 32])]
    flat = [(10 + i, "Male", 5.0, 1.0, 1.0, "Visual", "X") for i in range(2)]
    cohorts = prepare(people(ends).unionByName(people(flat, 2)))
    # The first centres of cohort 1 both lie at its lower end, so centroids have to move.
    slots = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 10)], "cohort_id bigint, slot int, profile_id bigint")
    _, cut = lloyd.kmeans(cohorts.profiles, slots, "euclidean", 1)
    assert {(r.cohort_id, r.rounds, r.converged) for r in cut.collect()} == {(1, 1, False), (2, 1, True)}
    _, whole = lloyd.kmeans(cohorts.profiles, slots, "euclidean")
    found = {r.cohort_id: (r.rounds, r.converged) for r in whole.collect()}
    assert found[2] == (1, True) and found[1][0] > 1 and found[1][1]


def test_duplicate_medoids_and_empty_clusters(spark, people):
    same = [(i, "Male", 1.0, 1.0, 1.0, "Visual", "X") for i in range(3)]
    cohorts = prepare(people([*same, (3, "Male", 4.0, 4.0, 4.0, "Visual", "X")]))
    slots = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "cohort_id bigint, slot int, profile_id bigint")
    labels, centers = lloyd.kmeans(cohorts.profiles, slots, "euclidean", 1)
    assert {r.slot for r in labels.collect()} == {0}
    # The empty slot keeps the centroid of profile 0.
    assert {r.slot: r.centroid[0] for r in centers.collect()}[1] < 0
    labels, found = medoids.kmedoids(cohorts.profiles, slots, "manhattan", 200)
    assert {(r.slot, r.profile_id) for r in found.collect()} == {(0, 3), (1, 0)}


def test_one_cluster_and_as_many_as_people(people):
    cohorts = prepare(people(plain(6)))
    for k in (1, 6):
        config = seeding.group_config(cohorts.people, 1, k=k)
        slots = seeding.init_medoids(cohorts.people, cohorts.profiles, config)
        labels, _ = medoids.kmedoids(cohorts.profiles, slots, "manhattan")
        assert labels.select("slot").distinct().count() == k


def test_cluster_bounds_are_checked(people):
    config = seeding.group_config(people(plain(3)), 1, k=4)
    with pytest.raises(ValueError, match=r"\(1, 3, 4\)"):
        seeding.check_clusters(config)
    for size, mode in ((0, "generate"), (1.5, "generate"), (True, "generate"), (1, "evaluate"), (101, "evaluate")):
        with pytest.raises(ValueError):
            seeding.check_group_size(size, mode)


def test_group_config_modes(people):
    df = people(plain(7))
    assert seeding.group_config(df, 10).first().k == 1
    assert seeding.group_config(df, 3).first().k == 2
    assert seeding.group_config(df, 10, "evaluate").first().k == 2
    assert seeding.group_config(people(plain(1)), 10, "evaluate").first().k == 1


def test_features_are_standardised_by_population(spark, people):
    df = people([(0, "Male", 1.0, 2.0, 1.0, "Auditory", "X"), (1, "Male", 3.0, 2.0, 2.0, "Visual", "X")])
    vectors = {r.profile_id: list(r.features) for r in encode(df).collect()}
    assert vectors == {0: [-1.0, 0.0, -1.0, 1.0, -1.0], 1: [1.0, 0.0, 1.0, -1.0, 1.0]}


def test_global_fit_uses_all_cohorts(people):
    df = people(plain(4)).unionByName(people(plain(8), cohort=2))
    out = encode(df, fit_scope="global")
    mean = out.agg(F.sum(F.col("weight") * F.col("z_motivation"))).first()[0]
    assert abs(mean) < 1e-9 and out.select("cohort_id").distinct().count() == 2


def test_principal_axes_are_eigenvectors(spark, small, people):
    cohorts, _ = small
    profiles = cohorts.profiles.unionByName(encode(people(plain(4, start=900), cohort=99).withColumn("Self_Esteem", F.lit(1.0)).withColumn(
        "Motivation", F.lit(1.0))))  # a cohort without any variance
    found = {(r.cohort_id, r.component): r for r in projection.principal_axes(profiles).collect()}
    cells = projection.feature_covariance(profiles).toPandas()
    for cohort, own in cells.groupby("cohort_id"):
        n = own["i"].max() + 1
        matrix = np.zeros((n, n))
        matrix[own["i"], own["j"]] = own["value"]
        values, vectors = np.linalg.eigh(matrix)
        if cohort == 99:
            assert found[cohort, 0].explained == found[cohort, 1].explained == 0 and not any(found[cohort, 0].axis)
            continue
        for component in (0, 1):
            axis, r = vectors[:, -1 - component], found[cohort, component]
            axis = axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1)
            assert r.explained == pytest.approx(values[-1 - component] / values.sum())
            if values[-1 - component] - values[-2 - component] > 1e-6 * values[-1]:
                assert np.abs(r.axis) == pytest.approx(np.abs(axis), abs=1e-7)
    shown = projection.project_2d(profiles.where("cohort_id <> 99"), projection.principal_axes(profiles)).agg(F.sum(F.col("weight") * F.col("pc1"))).first()[0]
    assert abs(shown) < 1e-6


def test_unknown_metric_fails(people):
    cohorts = prepare(people(plain(3)))
    with pytest.raises(ValueError, match="unknown metric"):
        lloyd.kmeans(cohorts.profiles, None, "cosine")


def test_rank_spans_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("bigint").alias("cohort_id"), F.col("id").alias("row_id"))
    got = {(r.cohort_id, r.row_id): r.rn for r in rank_in_cohort(df.repartition(13), ["row_id"]).collect()}
    for cohort in (0, 1):
        ids = sorted(r for c, r in got if c == cohort)
        assert [got[cohort, r] for r in ids] == list(range(1, len(ids) + 1))


def test_heavy_keys_are_split_without_losing_rows(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("row_id"))
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = join_by_weight(big, small, ["k"], "n", rows_per_task=50)
    assert out.count() == 1000 and out.where("k = 1 AND n = 900").count() == 900
