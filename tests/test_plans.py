from __future__ import annotations

from evenfold.operators import balance, locking, medoids, projection, separation
from evenfold.operators.distances import profile_distances
from evenfold.plans.cohorts import clean, prepare
from evenfold.sources.learners import learners
from tests.conftest import SMALL


def physical(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_no_operator_needs_one_partition_or_a_cross_join(spark):
    cohorts = prepare(learners(spark, SMALL))
    labelled = balance.as_run(cohorts.people.selectExpr("*", "CAST(row_id % 2 AS INT) AS group_id"), "r")
    cells = separation.group_profiles(labelled)
    slots = cohorts.profiles.selectExpr("cohort_id", "CAST(profile_id AS INT) AS slot", "profile_id")
    near = medoids.nearest_medoids(medoids.signature(cohorts.profiles, "manhattan"), slots, "manhattan")
    for df in (
        profile_distances(cohorts.profiles, "manhattan"),
        separation.silhouette(cells, cohorts.profiles),
        separation.davies_bouldin(cells, cohorts.profiles),
        medoids.swap_parts(near, "manhattan"),
        locking.gender_isolation(labelled),
        balance.cluster_balance(labelled),
        projection.principal_axes(cohorts.profiles),
    ):
        plan = physical(df)
        for word in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "MapInArrow"):
            assert word not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = physical(clean(learners(spark, SMALL)))
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "c_acctbal" in schema and "c_phone" not in schema and "c_comment" not in schema


def test_top_two_are_cut_before_the_shuffle(spark):
    cohorts = prepare(learners(spark, SMALL))
    slots = cohorts.profiles.selectExpr("cohort_id", "CAST(profile_id AS INT) AS slot", "profile_id")
    near = medoids.nearest_medoids(medoids.signature(cohorts.profiles, "manhattan"), slots, "manhattan")
    assert "WindowGroupLimit" in physical(near)
