from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evenfold.operators.separation import group_profiles
from evenfold.operators.vectors import (
    attach_vector_profiles, kmeans_vectors, separation_vectors, silhouette_vectors, vector_profiles)
from evenfold.operators import lloyd, separation
from evenfold.operators.balance import as_run
from evenfold.operators.profiles import FULL_KEYS
from evenfold.operators.reach import VECTOR, block_reach
from evenfold.plans.cohorts import prepare
from evenfold.sources.learners import learners

SCHEMA = "run string, cohort_id bigint, row_id bigint, group_id int, vector array<double>"


def _labelled(spark, n=90, groups=4, cohorts=2, seed=3):
    """Clouds around a few centres, a third of the rows on one and the same vector but in different groups."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(cohorts):
        for i in range(n):
            x = [0.25, -0.5, 1.0] if i % 3 == 0 else (rng.normal(size=3) + 2 * (i % groups)).round(3).tolist()
            rows.append(("r", c, i, i % groups, x))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def _silhouette(rows) -> float:
    x, g = np.array([r[4] for r in rows]), np.array([r[3] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = g == g[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, g == o].mean() for o in set(g.tolist()) - {g[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [2048, 7])
def test_silhouette_in_blocks_is_that_of_all_pairs(spark, block):
    rows, df = _labelled(spark)
    profiles = vector_profiles(df)
    cells = group_profiles(df.drop("vector").join(attach_vector_profiles(df, profiles), ["cohort_id", "row_id"]))
    got = {r["cohort_id"]: r["silhouette"] for r in silhouette_vectors(cells, profiles, block).collect()}
    for c in (0, 1):
        assert got[c] == pytest.approx(_silhouette([r for r in rows if r[1] == c]), abs=1e-9)


def test_kmeans_is_lloyd_on_the_rows(spark):
    rows, df = _labelled(spark)
    labels, centroids = kmeans_vectors(df, 4)
    got = {(r["cohort_id"], r["row_id"]): r["label"] for r in labels.collect()}
    centres = {(r["cohort_id"], r["slot"]): np.array(r["centroid"]) for r in centroids.collect()}
    assert len(got) == len(rows) and len(centres) == 8
    for _, c, i, _, x in rows:  # at the end everybody is at their nearest centre, and each centre is its rows' mean
        gaps = [((np.array(x) - centres[c, s]) ** 2).sum() for s in range(4)]
        assert gaps[got[c, i]] <= min(gaps) + 1e-9
    for (c, s), centre in centres.items():
        own = [r[4] for r in rows if r[1] == c and got[c, r[2]] == s]
        if own:
            assert np.abs(np.mean(own, axis=0) - centre).max() < 2e-6


@pytest.mark.parametrize("vector", [None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1.0, 2.0], []])
def test_broken_vectors_are_named(spark, vector):
    df = spark.createDataFrame([("r", 0, 1, 0, [1.0, 2.0, 3.0]), ("r", 0, 7, 1, vector)], SCHEMA)
    with pytest.raises(ValueError, match=r"\(0, 7\)"):
        vector_profiles(df)


def test_empty_one_group_and_a_group_per_row(spark):
    assert kmeans_vectors(spark.createDataFrame([], SCHEMA), 3)[0].isEmpty()
    assert separation_vectors(spark.createDataFrame([], SCHEMA)).isEmpty()
    alike = [("one", 0, i, 0, [float(i)]) for i in range(4)] + [("each", 0, i, i, [float(i)]) for i in range(4)]
    for r in separation_vectors(spark.createDataFrame(alike, SCHEMA)).collect():
        assert r["silhouette"] is None and r["davies_bouldin"] is None and r["calinski_harabasz"] is None
    with pytest.raises(ValueError, match="out of range"):
        kmeans_vectors(spark.createDataFrame(alike[:2], SCHEMA), 3)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("rounds", [2, 300])
def test_steered_rounds_are_those_of_tables(spark, metric, rounds):
    _, df = _labelled(spark)
    profiles = vector_profiles(df)
    slots = profiles.where("profile_id % 7 = 0").select(
        "cohort_id", "profile_id", (F.row_number().over(Window.partitionBy("cohort_id").orderBy("profile_id")) - 1).alias("slot"))
    steered, tables = (f(profiles, slots, metric, rounds) for f in (lloyd.kmeans_steered, lloyd.kmeans))
    for one, other in zip(steered, tables):
        columns = sorted(one.columns)
        assert sorted(map(str, one.select(*columns).collect())) == sorted(map(str, other.select(*columns).collect()))
    assert steered[0].count() == profiles.count()


@pytest.mark.parametrize("metric", ["euclidean", "gower"])
def test_silhouette_of_people_in_small_blocks(spark, monkeypatch, metric):
    cohorts = prepare(learners(spark, "/root/testdata/sf0.001").where("cohort_id < 4"), FULL_KEYS)
    cells = group_profiles(as_run(cohorts.people.withColumn("group_id", F.pmod(F.col("row_id"), F.lit(3)).cast("int")), "x"))
    profiles = cohorts.profiles
    placed = cells.join(profiles.drop("weight"), ["cohort_id", "profile_id"])
    whole = {r["cohort_id"]: r["silhouette"] for r in separation.silhouette(cells, profiles, metric).collect()}
    cut = separation._by_blocks(cells, placed, metric, separation.NEEDS[metric], 2, 2)  # every group is cut
    assert {r["cohort_id"]: r["silhouette"] for r in cut.collect()} == pytest.approx(whole, abs=1e-12) and len(whole) == 4


def test_few_sums_leave_a_block():
    """Of 50 groups each profile tells its own and the two nearest, not all."""
    n = 50
    cells = [(i, i, 1, float(i)) for i in range(n)]
    table = pa.table({"run": ["x"] * 2 * n, "cohort_id": [1] * 2 * n, "profile_id": [c[0] for c in cells] * 2,
                      "group_id": pa.array([None] * n + [c[1] for c in cells], pa.int64()), "people": [0] * n + [1] * n, "size": [0] * n + [1] * n,
                      "cut": [False] * 2 * n, "features": [[c[3], 0.0] for c in cells] * 2})
    found = block_reach(table, VECTOR).to_pylist()
    assert len(found) == 2 * n  # a profile is nearest to its own group
    assert {r["group_id"]: r["total"] for r in found if r["profile_id"] == 7} == {7: 0.0, 6: 1.0}


def test_vectors_are_shuffled_a_few_times(spark, monkeypatch):
    """A table of many blocks' worth of vectors is cut into as many blocks as the tasks need, not into ever more of them."""
    cut = []
    by_blocks = separation._by_blocks
    monkeypatch.setattr(separation, "_by_blocks", lambda *a: cut.append(a[4:]) or by_blocks(*a))
    monkeypatch.setattr("evenfold.operators.vectors.BLOCK", 4)
    rows, df = _labelled(spark)
    found = {r["cohort_id"]: r["silhouette"] for r in separation_vectors(df).collect()}
    for c in (0, 1):
        assert found[c] == pytest.approx(_silhouette([r for r in rows if r[1] == c]), abs=1e-9)
    ((points, cells, finer),) = cut
    assert points == cells == (1 << 25) // 24 and finer == (4, 8)


@pytest.mark.parametrize("repeated", [False, True])
def test_tiles_of_a_block_give_its_sums(monkeypatch, repeated):
    """Groups that begin and end inside tiles, near and equal vectors, weights; with repeated vectors the rows share distances."""
    monkeypatch.setattr("evenfold.operators.reach.POINTS", 7)
    monkeypatch.setattr("evenfold.operators.reach.COLUMNS", 5)
    rng = np.random.default_rng(2)
    n = 40
    x = rng.normal(size=(n, 3))
    x[7], x[9], x[11] = x[3], x[3] + 1e-9, 1e5
    group, people = rng.integers(0, 6, n), rng.integers(1, 4, n)
    cells = [(i, int(group[i]), int(people[i])) for i in range(n)] + ([(i, int(group[i]) + 6, 1) for i in range(0, n, 3)] if repeated else [])
    table = pa.table({"run": ["x"] * (n + len(cells)), "cohort_id": [1] * (n + len(cells)), "profile_id": [*range(n), *[c[0] for c in cells]],
                      "group_id": pa.array([None] * n + [c[1] for c in cells], pa.int64()), "people": [0] * n + [c[2] for c in cells], "size": [1] * (n + len(cells)),
                      "cut": [True] * (n + len(cells)), "features": [x[i].tolist() for i in [*range(n), *[c[0] for c in cells]]]})
    found = {(r["profile_id"], r["group_id"]): r["total"] for r in block_reach(table, VECTOR).to_pylist()}
    assert len(found) == n * len({c[1] for c in cells})
    for (i, g), total in found.items():
        assert total == pytest.approx(sum(w * np.sqrt(((x[i] - x[j]) ** 2).sum()) for j, h, w in cells if h == g), rel=1e-9, abs=1e-12)
