from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from evenfold.operators import balance, locking, separation, sizing
from evenfold.operators.ranking import rank_in_cohort
from evenfold.plans.cohorts import prepare
from evenfold.plans.generate import generate_groups
from evenfold.plans.report import group_assignments, report_lines
from evenfold.session import checkpoint
from evenfold.sources.learners import learners
from evenfold.sources.sinks import write_assignments, write_report
from tests.kernels import plain_swaps
from tests.conftest import SMALL, plain


def grouped(df, groups):
    """Label people of one cohort: row i goes to groups[i]."""
    mapping = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(i), F.lit(g))])
    return df.withColumn("group_id", mapping[F.col("row_id").cast("int")].cast("int"))


def group_of(df):
    return {r.row_id: r.group_id for r in df.collect()}


def test_undersized_cohort_is_one_group(people):
    cohorts = prepare(people(plain(3)))
    out = sizing.enforce_group_size(cohorts.people.withColumn("label", F.lit(0)), 5, cohorts.profiles)
    assert set(group_of(out).values()) == {0}


def test_left_over_row_joins_one_group(people):
    cohorts = prepare(people(plain(31)))
    out = sizing.enforce_group_size(cohorts.people.withColumn("label", F.lit(0)), 5, cohorts.profiles)
    sizes = sorted(r["count"] for r in out.groupBy("group_id").count().collect())
    assert sizes == [5] * 5 + [6]


def test_equal_left_over_rows_share_a_magnet(people):
    rows = plain(30) + [(30 + i, "Male", 1.0, 1.0, 2.0, "Visual", "Hispanic") for i in range(3)]
    cohorts = prepare(people(rows))
    out = sizing.enforce_group_size(cohorts.people.withColumn("label", F.lit(0)), 5, cohorts.profiles)
    assert max(r["count"] for r in out.groupBy("group_id").count().collect()) == 8


def test_round_robin(people):
    labels = people(plain(33)).withColumn("label", F.lit(0))
    sizes = {r.group_id: r["count"] for r in sizing.enforce_group_size(labels, 5).groupBy("group_id").count().collect()}
    assert sizes == {0: 6, 1: 6, 2: 6, 3: 5, 4: 5, 5: 5}


@pytest.mark.parametrize("genders, expected", [
    (["Female", "Male", "Male"], None),
    (["Female", "Male", "Male", "Male"], "female_isolated"),
    (["Male", "Female", "Female", "Other"], "male_isolated"),
    (["Female", "Male", "Other", "Other"], None),
])
def test_isolation_rule(people, genders, expected):
    df = people([(i, g, 1.0, 1.0, 1.0, "Visual", "X") for i, g in enumerate(genders)])
    found = locking.gender_isolation(grouped(df, [0] * len(genders))).collect()
    assert [r.isolation_type for r in found] == ([expected] if expected else [])


def scene(people, genders, groups):
    cohorts = prepare(people([(i, g, 1.0 + i % 4, 1.0 + i % 3, 2.0, "Visual", "X") for i, g in enumerate(genders)]))
    return grouped(cohorts.people, groups), cohorts.profiles


def test_swap_can_isolate_the_donor(people):
    genders = ["Female", "Male", "Male", "Male", "Female", "Female", "Female", "Female"]
    labelled, profiles = scene(people, genders, [0] * 4 + [1] * 4)
    out, log = locking.fix_isolation(labelled, profiles, locking.gender_rule())
    counts = {(r.group_id, r.Gender): r["count"] for r in out.groupBy("group_id", "Gender").count().collect()}
    assert counts == {(0, "Female"): 2, (0, "Male"): 2, (1, "Female"): 3, (1, "Male"): 1}
    assert log.count() == 1
    strict, log = locking.fix_isolation(labelled, profiles, locking.gender_rule(True))
    assert group_of(strict) == group_of(labelled) and log.count() == 0


def test_no_donor_leaves_labels(people):
    labelled, profiles = scene(people, ["Female", "Male", "Male", "Male", "Female", "Female", "Male", "Male"], [0] * 4 + [1] * 4)
    out, log = locking.fix_gender_isolation(labelled, profiles)
    assert group_of(out) == group_of(labelled) and log.count() == 0


@pytest.mark.parametrize("rule", [locking.gender_rule(), locking.gender_rule(True), locking.diversity_rule()])
def test_swap_jobs_match_a_plain_loop(spark, rule):
    cohorts = prepare(learners(spark, SMALL).where("cohort_id < 4"))
    labelled = cohorts.people.withColumn("group_id", F.pmod(F.col("row_id"), F.lit(2)).cast("int"))
    _, log = locking.fix_isolation(labelled, cohorts.profiles, rule, max_rounds=3)
    assert sorted(map(tuple, log.collect())) == sorted(plain_swaps(labelled, cohorts.profiles, rule, 3))


def test_missing_genders_match_nobody(people):
    genders = ["Female", "Male", *[None] * 7]
    kinds = ["A", "B", "B", "B", "B", "A", "A", "A", "A"]
    cohorts = prepare(people([(i, g, 1.0, 1.0, 1.0, "Visual", d) for i, (g, d) in enumerate(zip(genders, kinds))]))
    labelled = grouped(cohorts.people, [0] * 5 + [1] * 4)
    out, log = locking.fix_isolation(labelled, cohorts.profiles, locking.diversity_rule())
    assert log.count() == 0 and group_of(out) == group_of(labelled)


def test_swaps_in_large_unsized_groups(spark):
    """Many people of few profiles: only the first of each profile can be in the best swap."""
    cohorts = prepare(learners(spark, "/root/testdata/sf0.01").where("cohort_id < 3"))
    labelled = cohorts.people.withColumn("group_id", F.pmod(F.col("row_id"), F.lit(3)).cast("int"))
    rule = locking.diversity_rule(False)
    lone = labelled.where("Diversity <> 'Hispanic' OR row_id < 60")
    _, log = locking.fix_isolation(lone, cohorts.profiles, rule)
    assert sorted(map(tuple, log.collect())) == sorted(plain_swaps(lone, cohorts.profiles, rule, 1_000))


def one_cohort(spark, sf, size):
    """Everybody in one cohort, in groups of ``size`` neighbours."""
    people = learners(spark, sf).withColumn("row_id", F.col("cohort_id") * 1_000_000 + F.col("row_id")).withColumn("cohort_id", F.lit(1).cast("bigint"))
    cohorts = prepare(people)
    ranked = rank_in_cohort(cohorts.people, ["row_id"])
    return checkpoint(ranked.withColumn("group_id", F.floor((F.col("rn") - 1) / size).cast("int")).drop("rn")), cohorts.profiles


@pytest.fixture
def batches(monkeypatch):
    """How many batches were solved."""
    solved = []
    solve = locking._batch
    monkeypatch.setattr(locking, "_batch", lambda *args: solved.append(1) or solve(*args))
    return solved


@pytest.mark.parametrize("rule", [locking.gender_rule(), locking.diversity_rule()])
def test_batches_cut_anywhere_give_the_same_swaps(spark, monkeypatch, batches, rule):
    """Short lists, few turns and no spare kinds: batches end early, for every reason there is."""
    labelled, profiles = one_cohort(spark, SMALL, 5)
    monkeypatch.setattr(locking, "CHOICES", 2)
    monkeypatch.setattr(locking, "COMMON_KINDS", 0)
    monkeypatch.setattr(locking, "BATCH_TURNS", 5)
    _, log = locking.fix_isolation(labelled, profiles, rule, max_rounds=13)
    expected = plain_swaps(labelled, profiles, rule, 13)
    assert len(expected) > 5 and sorted(map(tuple, log.collect())) == sorted(expected)
    assert len(batches) > 2


def test_batches_are_bounded_in_people(spark, monkeypatch, batches):
    labelled, profiles = one_cohort(spark, SMALL, 5)
    monkeypatch.setattr(locking, "BATCH_PEOPLE", 100)  # one turn a batch
    _, log = locking.fix_isolation(labelled, profiles, locking.gender_rule(), max_rounds=3)
    assert sorted(map(tuple, log.collect())) == sorted(plain_swaps(labelled, profiles, locking.gender_rule(), 3))
    assert len(batches) == 3


def test_a_large_cohort_takes_few_batches(spark, batches):
    labelled, profiles = one_cohort(spark, "/root/testdata/sf0.1", 5)
    flagged = locking.gender_isolation(labelled).count()
    _, log = locking.fix_isolation(labelled, profiles, locking.gender_rule())
    expected = plain_swaps(labelled, profiles, locking.gender_rule(), flagged)
    assert len(expected) > 1_000 and sorted(map(tuple, log.collect())) == sorted(expected)
    assert labelled.count() == 15_000 and len(batches) <= flagged / 300


@pytest.mark.parametrize("rule", [locking.gender_rule(), locking.gender_rule(True), locking.diversity_rule(), locking.diversity_rule(False)])
def test_a_cohort_known_whole_takes_one_batch(spark, batches, rule):
    labelled, profiles = one_cohort(spark, "/root/testdata/sf0.01", 5)
    _, log = locking.fix_isolation(labelled, profiles, rule)
    expected = plain_swaps(labelled, profiles, rule, 10_000)
    assert len(expected) > 100 and sorted(map(tuple, log.collect())) == sorted(expected)
    assert len(batches) == 1


def test_lists_of_larger_cohorts_give_the_same_swaps(spark, monkeypatch, batches):
    labelled, profiles = one_cohort(spark, SMALL, 5)
    other = labelled.withColumn("cohort_id", F.col("cohort_id") + 1).where("row_id < 5000000")
    both, shapes = labelled.unionByName(other), profiles.unionByName(profiles.withColumn("cohort_id", F.col("cohort_id") + 1))
    monkeypatch.setattr(locking, "BATCH_PEOPLE", 100)  # the second cohort is taken whole
    _, log = locking.fix_isolation(both, shapes, locking.diversity_rule(), max_rounds=4)
    assert other.count() < 100 and sorted(map(tuple, log.collect())) == sorted(plain_swaps(both, shapes, locking.diversity_rule(), 4))
    assert len(batches) == 4


def test_second_pass_flags_again(spark):
    cohorts = prepare(learners(spark, SMALL))
    labelled = cohorts.people.withColumn("group_id", F.pmod(F.col("row_id"), F.lit(2)).cast("int"))
    once, _ = locking.fix_gender_isolation(labelled, cohorts.profiles)
    twice, log = locking.fix_gender_isolation(labelled, cohorts.profiles, max_passes=2)
    assert locking.gender_isolation(twice).count() <= locking.gender_isolation(once).count()
    assert once.count() == twice.count() == labelled.count()


def test_scores_of_degenerate_groupings_are_null(people):
    cohorts = prepare(people(plain(6)))
    one = balance.as_run(cohorts.people.withColumn("group_id", F.lit(0)), "one")
    each = balance.as_run(cohorts.people.withColumn("group_id", F.col("row_id").cast("int")), "each")
    cells = separation.group_profiles(one.unionByName(each))
    for frame in (separation.silhouette(cells, cohorts.profiles), separation.davies_bouldin(cells, cohorts.profiles),
                  separation.calinski_harabasz(cells, cohorts.profiles)):
        assert [r[2] for r in frame.collect()] == [None, None]


def test_singleton_variance(people):
    labelled = balance.as_run(grouped(people(plain(3)), [0, 0, 1]), "r")
    by_cluster = {r.group_id: r.mean_skill_variance for r in balance.skill_variance_by_cluster(labelled).collect()}
    assert by_cluster[1] == 0.0 and by_cluster[0] > 0
    overall = balance.skill_variance_overall(labelled).first()
    assert math.isnan(overall.overall_mean_variance) and math.isnan(overall.overall_std_variance)
    assert overall.overall_mean_variance_nonsingleton == by_cluster[0]


def test_entropy_without_the_column_is_zero(people):
    labelled = balance.as_run(grouped(people(plain(2)), [0, 0]), "r")
    out = balance.cluster_entropy(labelled.drop("Diversity")).first()
    assert out.diversity_entropy == 0.0 and abs(out.gender_entropy) < 1e-9


def test_empty_groups_are_listed(spark, people):
    config = spark.createDataFrame([(1, 3)], "cohort_id bigint, k bigint")
    out = balance.group_members(grouped(people(plain(3)), [2, 0, 2]), config)
    assert sorted((r.group_id, r.position, r.Name) for r in out.collect()) == [
        (0, 1, "P001"), (1, 0, None), (2, 1, "P000"), (2, 2, "P002")]


# Women, men and people per diversity category of ten known groups, and their mean entropies.
KNOWN_GROUPS = [
    (4, 6, (2, 1, 3, 4)), (4, 6, (1, 5, 2, 2)), (4, 6, (2, 2, 2, 4)), (5, 5, (3, 1, 2, 4)), (4, 6, (2, 2, 3, 3)),
    (6, 4, (3, 2, 2, 3)), (5, 5, (2, 4, 3, 1)), (6, 4, (1, 2, 5, 2)), (5, 5, (3, 4, 1, 2)), (7, 3, (6, 1, 2, 1)),
]


def test_scores_of_known_groups(spark):
    members = []
    for group, (women, men, counts) in enumerate(KNOWN_GROUPS):
        genders = ["Female"] * women + ["Male"] * men
        categories = [c for c, n in zip(("Asian", "Black", "Hispanic", "White"), counts) for _ in range(n)]
        members += [(1, 10 * group + i, g, c, group) for i, (g, c) in enumerate(zip(genders, categories))]
    people = spark.createDataFrame(members, "cohort_id bigint, row_id bigint, Gender string, Diversity string, group_id int")
    mean = balance.mean_entropy(balance.cluster_entropy(balance.as_run(people, "r"))).first()
    assert round(mean.mean_gender_entropy, 6) == 0.672838
    assert round(mean.mean_diversity_entropy, 6) == 1.271403
    assert locking.gender_isolation(people).count() == 0
    assert locking.diversity_isolation(people).count() == 8


def test_report_layout(spark):
    people = spark.createDataFrame(
        [(1, 0, "Zoe", "Female", "Kinesthetic", "Middle Eastern And North African", 0),
         (1, 1, "Abe", "Male", "Visual", None, 0)],
        "cohort_id bigint, row_id bigint, Name string, Gender string, Learning_Style string, Diversity string, group_id int")
    lines = [r.line for r in report_lines(group_assignments(people)).orderBy("group_id", "line_no").collect()]
    assert lines == [
        "", "=" * 65, "FINAL GROUP ASSIGNMENTS REPORT", "=" * 65, "", " GROUP 1 (2 students)", "-" * 65,
        "Name                 | Gender   | Ethnicity            | Style     ", "-" * 65,
        "Abe                  | Male     | nan                  | Visual    ",
        "Zoe                  | Female   | Middle Eastern An..  | Kinesthetic", "-" * 65]


def test_generated_groups_hold_everybody(spark, tmp_path):
    people = learners(spark, SMALL)
    result = generate_groups(people, 4)
    out = result.assignments
    assert out.columns[0] == "Group_ID"
    assert out.count() == out.select("cohort_id", "row_id").distinct().count() == people.count()
    sizes = out.groupBy("cohort_id", "Group_ID").count()
    totals = out.groupBy("cohort_id").agg(F.count("*").alias("n"))
    assert sizes.join(totals, "cohort_id").where("count < 4 AND n >= 4").isEmpty()
    again = generate_groups(people.repartition(5), 4).assignments
    key = ["cohort_id", "row_id", "Group_ID"]
    assert out.select(*key).exceptAll(again.select(*key)).isEmpty()
    write_assignments(out, str(tmp_path / "csv"))
    write_report(report_lines(out), str(tmp_path / "text"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == out.count() and back.columns[0] == "Group_ID"
