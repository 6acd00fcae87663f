"""Isolation: find groups where somebody is alone, and swap people to end it.

A cohort treats its flagged groups one after the other, each on the labels the one before
left. A cohort of at most ``BATCH_PEOPLE`` people and ``WHOLE_PROFILES`` profiles is known whole to its task, which takes
all turns (``whole_turns``). In larger ones a round takes a batch of the next flagged groups: joins list the nearest donors for all of
them at once, then ``turns`` goes through the batch in order and commits every turn whose best swap these
lists decide. A batch holds a bounded number of groups and people, whatever the size of the cohort.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.functions.measure import manhattan
from evenfold.operators.joins import cohort_groups, pair_within, prefixed, two_nearest
from evenfold.operators.ranking import rank_in_cohort
from evenfold.operators.turns import take_turns
from evenfold.operators.whole_turns import PERSON, PROFILE, TURN, whole_turns
from evenfold.session import checkpoint

# A smaller group cannot isolate anybody; a donor must hold more than this
# many of the wanted gender.
SMALLEST_GROUP = 4
DONOR_KEEPS = 2

# Donor groups listed for each kind of person who may leave; kinds listed although nobody of them is in a due
# group yet; turns in a batch, and in a batch with lists; people and profiles of a cohort known whole, from which larger cohorts
# derive fewer turns. All of them bound a batch and none a result: what a batch does not decide opens the next one.
CHOICES = 16
COMMON_KINDS = 512
BATCH_TURNS = 200_000
LIST_TURNS = 512
BATCH_PEOPLE = 1_000_000
WHOLE_PROFILES = 2_048
# Listed people are objects, five times as large as the numbers of people known whole.
LIST_SHARE = 5

LOG_SCHEMA = (
    "cohort_id bigint, round int, group_id int, isolation_type string, in_id bigint, "
    "donor_group int, out_id bigint, dist bigint"
)
BATCH_SCHEMA = "cohort_id bigint, turn bigint, group_id int, isolation_type string, in_id bigint, donor_group int, out_id bigint, dist bigint"
_GEOMETRY = ("Learning_Style", "q_motivation", "q_esteem", "q_ethic", "q_gap")


def gender_isolation(labelled: DataFrame) -> DataFrame:
    """``cohort_id, group_id, isolation_type`` of groups with one woman or one man alone."""
    counts = labelled.groupBy("cohort_id", "group_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("Gender") == "Female").alias("women"),
        F.count_if(F.col("Gender") == "Male").alias("men"),
    )
    kind = F.when((F.col("women") == 1) & (F.col("men") > 1), F.lit("female_isolated")).when(
        (F.col("men") == 1) & (F.col("women") > 1), F.lit("male_isolated"))
    return counts.where(F.col("size") >= SMALLEST_GROUP).select(
        "cohort_id", "group_id", kind.alias("isolation_type")).where("isolation_type IS NOT NULL")


def diversity_isolation(labelled: DataFrame) -> DataFrame:
    """``cohort_id, group_id, Diversity, isolation_type``: categories with one member in a group of several."""
    counts = labelled.groupBy("cohort_id", "group_id", "Diversity").agg(F.count(F.lit(1)).alias("_n"))
    sizes = labelled.groupBy("cohort_id", "group_id").agg(F.count(F.lit(1)).alias("_size"))
    return (
        counts.where("_n = 1 AND Diversity IS NOT NULL").join(sizes, ["cohort_id", "group_id"]).where("_size > 1")
        .select("cohort_id", "group_id", "Diversity",
                F.concat("Diversity", F.lit("_isolated")).alias("isolation_type"))
    )


@dataclass(frozen=True)
class SwapRule:
    """Who may be swapped for whom.

    ``attribute`` is what isolates; ``match`` is a column both sides of a swap must share.
    """

    attribute: str
    match: str | None = None
    strict_donor: bool = False

    def flag(self, labelled: DataFrame) -> DataFrame:
        """Flagged groups with the ``wanted`` value and, for genders, the ``given`` one."""
        if self.attribute == "Gender":
            lone_woman = F.col("isolation_type") == "female_isolated"
            return gender_isolation(labelled).select(
                "cohort_id", "group_id", "isolation_type",
                F.when(lone_woman, F.lit("Female")).otherwise(F.lit("Male")).alias("wanted"),
                F.when(lone_woman, F.lit("Male")).otherwise(F.lit("Female")).alias("given"))
        return diversity_isolation(labelled).select(
            "cohort_id", "group_id", "isolation_type", F.col("Diversity").alias("wanted"),
            F.lit(None).cast("string").alias("given"))

    def can_spare(self) -> Column:
        """Cells whose group can spare one of the trait."""
        held = F.col("held")
        if self.attribute != "Gender":
            return (held > DONOR_KEEPS) | (held == 1)
        if self.strict_donor:
            other = F.when(F.col("trait") == "Female", F.col("men")).otherwise(F.col("women"))
            return (held > DONOR_KEEPS) & (other >= 1)
        return held > DONOR_KEEPS

    def may_go(self) -> Column:
        """Cells of a flagged group whose people can leave it."""
        if self.attribute == "Gender":
            return F.col("trait") == F.col("given")
        held = F.col("held")
        return (F.col("trait") != F.col("wanted")) & ((held > DONOR_KEEPS) | (held == 1))


def gender_rule(strict_donor: bool = False) -> SwapRule:
    return SwapRule("Gender", None, strict_donor)


def diversity_rule(keep_genders: bool = True) -> SwapRule:
    return SwapRule("Diversity", "Gender" if keep_genders else None)


def group_cells(rows: DataFrame, rule: SwapRule) -> DataFrame:
    """People of one group, trait and profile as one cell with its smallest ``row_id``.

    ``held`` is how many of that trait the group has. Equal people tie in every distance,
    so the smallest id of a cell stands for all of it.
    """
    match = F.col(rule.match) if rule.match else F.lit("")
    cells = rows.groupBy(
        "cohort_id", "group_id", F.col(rule.attribute).alias("trait"), match.alias("match"), "profile_id",
    ).agg(F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("row_id"))
    same_group = Window.partitionBy("cohort_id", "group_id")
    same_trait = Window.partitionBy("cohort_id", "group_id", "trait")
    if rule.strict_donor:
        for name, gender in (("women", "Female"), ("men", "Male")):
            cells = cells.withColumn(name, F.sum(F.when(F.col("trait") == gender, F.col("_n")).otherwise(0))
                                     .over(same_group))
    return cells.withColumn("held", F.sum("_n").over(same_trait)).drop("_n")


def donor_cells(rows: DataFrame, rule: SwapRule) -> DataFrame:
    """Cells that can spare somebody: ``cohort_id, group_id, trait, match, profile_id, row_id, held``."""
    return group_cells(rows, rule).where(rule.can_spare() & F.col("trait").isNotNull())


def best_swaps(rows: DataFrame, pending: DataFrame, profiles: DataFrame, rule: SwapRule) -> DataFrame:
    """The cheapest swap of each pending group on the labels in ``rows``.

    ``pending`` has ``cohort_id, flagged, wanted, given``. Ties go to the lowest donor group,
    then incoming row, then outgoing row. Groups without a possible swap are absent. Of
    the people to bring in, only the two lowest donor groups per trait and profile can win,
    the second in case the first is the flagged group itself.
    """
    cells = group_cells(rows, rule)
    spare = cells.where(rule.can_spare() & F.col("trait").isNotNull())
    coming = two_nearest(spare, ["cohort_id", "trait", "match", "profile_id"], "group_id", "row_id")
    going = (
        cells.join(pending.withColumn("group_id", F.col("flagged")), ["cohort_id", "group_id"])
        .where(rule.may_go())
        .groupBy("cohort_id", "flagged", "wanted", "match", "profile_id").agg(F.min("row_id").alias("out_id"))
    )
    shape = profiles.select("cohort_id", "profile_id", "peers", *_GEOMETRY)
    keys = ["cohort_id", "wanted", "match"]
    coming = coming.withColumnRenamed("trait", "wanted").join(shape, ["cohort_id", "profile_id"])
    going = going.join(shape, ["cohort_id", "profile_id"])
    load = going.groupBy(*keys).agg(F.count(F.lit(1)).alias("load"))
    going, coming = going.join(load, keys), coming.join(load, keys)
    kept = (*keys, "load")
    pairs = pair_within(prefixed(going, "b_", keep=kept), prefixed(coming, "a_", keep=kept),
                        keys, ["b_flagged", "b_profile_id"], "load")
    own = F.col("a_first_value") == F.col("b_flagged")
    donor = F.when(own, F.col("a_second_value")).otherwise(F.col("a_first_value"))
    bring = F.when(own, F.col("a_second_id")).otherwise(F.col("a_first_id"))
    best = F.min(F.when(donor.isNotNull(), F.struct(
        manhattan("a_", "b_").alias("dist"), donor.alias("donor_group"), bring.alias("in_id"),
        F.col("b_out_id").alias("out_id"))))
    return pairs.groupBy("cohort_id", F.col("b_flagged").alias("flagged")).agg(best.alias("_best")).where(
        "_best IS NOT NULL").select(
        "cohort_id", "flagged", "_best.in_id", "_best.donor_group", "_best.out_id", "_best.dist")


def donor_lists(cells: DataFrame, due: DataFrame, shape: DataFrame, rule: SwapRule, choices: int) -> DataFrame:
    """``cohort_id, wanted, match, profile_id, donor_group, in_id, dist``: the nearest donors, ``choices`` at most.

    One list for each trait a due group wants and each kind of person (match and profile) in the group; also for the
    commonest kinds of the cohort, as they may come into a due group before its turn. Of a profile to bring in, only
    the ``choices`` lowest donor groups can be in a list.
    """
    spare = cells.where(rule.can_spare() & F.col("trait").isNotNull() & F.col("match").isNotNull())
    lowest = Window.partitionBy("cohort_id", "trait", "match", "profile_id").orderBy("group_id")
    coming = (
        spare.withColumn("_nth", F.row_number().over(lowest)).where(F.col("_nth") <= choices)
        .select("cohort_id", F.col("trait").alias("wanted"), "match", "profile_id", "group_id", "row_id"))
    inside = cells.join(due.select("cohort_id", F.col("flagged").alias("group_id"), "wanted"), ["cohort_id", "group_id"])
    common = Window.partitionBy("cohort_id").orderBy(F.desc("_n"), "match", "profile_id")
    kinds = cells.groupBy("cohort_id", "match", "profile_id").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_nth", F.row_number().over(common)).where(F.col("_nth") <= COMMON_KINDS)
    may_come = kinds.join(due.select("cohort_id", "wanted").distinct(), "cohort_id")
    going = inside.select("cohort_id", "wanted", "match", "profile_id").union(
        may_come.select("cohort_id", "wanted", "match", "profile_id")).where("match IS NOT NULL").distinct()
    keys = ["cohort_id", "wanted", "match"]
    load = going.groupBy(*keys).agg(F.count(F.lit(1)).alias("load"))
    going, coming = (side.join(shape, ["cohort_id", "profile_id"]).join(load, keys) for side in (going, coming))
    kept = (*keys, "load")
    pairs = pair_within(prefixed(going, "b_", keep=kept), prefixed(coming, "a_", keep=kept), keys, ["b_profile_id"], "load")
    kind = ["cohort_id", "wanted", "match", F.col("b_profile_id").alias("profile_id")]
    nearest = pairs.groupBy(*kind, F.col("a_group_id").alias("donor_group")).agg(
        F.min(F.struct(manhattan("a_", "b_").alias("dist"), F.col("a_row_id").alias("in_id"))).alias("_best"))
    order = Window.partitionBy("cohort_id", "wanted", "match", "profile_id").orderBy("_best.dist", "donor_group")
    return nearest.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= choices).select(
        "cohort_id", "wanted", "match", "profile_id", "donor_group", "_best.in_id", "_best.dist")


def _known_people(rows: DataFrame, due: DataFrame, lists: DataFrame, shape: DataFrame, rule: SwapRule) -> DataFrame:
    """People of the due groups and of all listed donors, with how many of their trait the group holds.

    Of people alike in group, trait, match and profile a batch can move one per turn, so the first ``turns`` of them are enough.
    """
    groups = due.select("cohort_id", F.col("flagged").alias("group_id")).union(lists.select("cohort_id", "donor_group")).distinct()
    turns = due.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("turns"))
    match = F.col(rule.match) if rule.match else F.lit("")
    people = rows.join(groups, ["cohort_id", "group_id"], "left_semi").select(
        "cohort_id", "group_id", "row_id", "profile_id", F.col(rule.attribute).alias("trait"), match.alias("match")).where("trait IS NOT NULL")
    alike = Window.partitionBy("cohort_id", "group_id", "trait", "match", "profile_id").orderBy("row_id")
    counts = people.groupBy("cohort_id", "group_id", "trait").agg(F.count(F.lit(1)).alias("held"))
    first = people.withColumn("_nth", F.row_number().over(alike)).join(F.broadcast(turns), "cohort_id").where(F.col("_nth") <= F.col("turns"))
    return first.drop("_nth", "turns").join(counts, ["cohort_id", "group_id", "trait"]).join(shape, ["cohort_id", "profile_id"])


def _batch(rows: DataFrame, due: DataFrame, shape: DataFrame, rule: SwapRule, modes: set[bool]) -> DataFrame:
    """The decided turns of every cohort: the log's columns by ``turn``, without ids where no swap is possible."""
    parts = []
    for whole, solve in ((True, _whole_batch), (False, _list_batch)):
        if whole in modes:
            mine = due.where(F.col("whole") == whole).drop("whole")
            own = rows.join(mine.select("cohort_id").distinct(), "cohort_id", "left_semi") if len(modes) > 1 else rows
            parts.append(solve(own, mine, shape, rule))
    return reduce(DataFrame.unionByName, parts)


def _whole_batch(rows: DataFrame, due: DataFrame, shape: DataFrame, rule: SwapRule) -> DataFrame:
    """All due turns of cohorts that fit into a task, by looking through profiles instead of lists."""
    match = F.col(rule.match) if rule.match else F.lit("")
    people = rows.select(F.lit(PERSON).alias("kind"), "cohort_id", "group_id", "row_id", "profile_id",
                         F.col(rule.attribute).alias("trait"), match.alias("match"))
    turns = due.select(F.lit(TURN).alias("kind"), "cohort_id", "turn", F.col("flagged").alias("group_id"), "isolation_type",
                       F.col("wanted").alias("trait"), "given")
    shapes = shape.join(due.select("cohort_id").distinct(), "cohort_id", "left_semi").select(F.lit(PROFILE).alias("kind"), "cohort_id", "profile_id", *_GEOMETRY)
    by_gender, strict_donor, keeps = rule.attribute == "Gender", rule.strict_donor, DONOR_KEEPS

    def solve(table: pa.Table) -> pa.Table:
        return whole_turns(table, by_gender, strict_donor, keeps)

    dealt = turns.unionByName(people, allowMissingColumns=True).unionByName(shapes, allowMissingColumns=True)
    return cohort_groups(dealt).applyInArrow(solve, BATCH_SCHEMA)


def _list_batch(rows: DataFrame, due: DataFrame, shape: DataFrame, rule: SwapRule) -> DataFrame:
    """The next turns of larger cohorts, as far as the lists of nearest donors decide them."""
    lists = checkpoint(donor_lists(group_cells(rows, rule), due, shape, rule, CHOICES))
    people = _known_people(rows, due, lists, shape, rule)
    whole = F.lit(0).cast("bigint")
    known = people.select(F.lit("person").alias("kind"), "cohort_id", "group_id", "row_id", "trait", "match", "profile_id", "held",
                          *_GEOMETRY, whole.alias("dist")).unionByName(
        lists.select(F.lit("entry").alias("kind"), "cohort_id", F.col("donor_group").alias("group_id"), F.col("in_id").alias("row_id"),
                     F.col("wanted").alias("trait"), "match", "profile_id", whole.alias("held"), F.lit(None).cast("string").alias("Learning_Style"),
                     *[whole.alias(c) for c in _GEOMETRY[1:]], "dist"))
    by_gender, strict_donor, keeps, choices = rule.attribute == "Gender", rule.strict_donor, DONOR_KEEPS, CHOICES

    def solve(due: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return take_turns(due, known, by_gender, strict_donor, keeps, choices)

    return cohort_groups(due).cogroup(cohort_groups(known)).applyInPandas(solve, BATCH_SCHEMA)


def _apply(rows: DataFrame, log: DataFrame, order: str = "round") -> DataFrame:
    """Current labels: the last swap a person was in decides."""
    moves = log.select("cohort_id", order, F.explode(F.array(
        F.struct(F.col("in_id").alias("row_id"), F.col("group_id").alias("_to")),
        F.struct(F.col("out_id").alias("row_id"), F.col("donor_group").alias("_to")))).alias("_m"))
    last = moves.groupBy("cohort_id", F.col("_m.row_id").alias("row_id")).agg(
        F.max_by("_m._to", order).alias("_to"))
    return rows.join(last, ["cohort_id", "row_id"], "left").withColumn(
        "group_id", F.coalesce("_to", "group_id")).drop("_to")


def fix_isolation(labelled: DataFrame, profiles: DataFrame, rule: SwapRule, max_passes: int = 1,
                  max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels after the swaps, and the swap log.

    The flagged groups are listed once per pass, in ascending order; every swap is judged on
    the labels current at its turn. ``max_rounds`` ends a pass early.
    """
    base = checkpoint(labelled)
    shape = checkpoint(profiles.select("cohort_id", "profile_id", *_GEOMETRY))
    log, turns = None, 0
    for _ in range(max_passes):
        start = base if log is None else _apply(base, log)
        flagged = checkpoint(rank_in_cohort(rule.flag(start), ["group_id", "wanted"], "turn"))
        turn_count = flagged.agg(F.max("turn")).first()[0]
        if turn_count is None:
            break
        turn_count = turn_count if max_rounds is None else min(turn_count, max_rounds)
        found = _swap_turns(start, flagged.where(F.col("turn") <= turn_count), shape, rule, turns)
        log = found if log is None else log.unionByName(found)
        turns += turn_count
    if log is None:
        log = base.sparkSession.createDataFrame([], LOG_SCHEMA)
        return base, log
    return _apply(base, log), log


def _swap_turns(base: DataFrame, flagged: DataFrame, shape: DataFrame, rule: SwapRule, turns_before: int) -> DataFrame:
    """The log of one pass, batch after batch; cohorts whose turns are over drop out."""
    largest = base.groupBy("cohort_id", "group_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("cohort_id").agg(
        F.max("_n").alias("_largest"), F.sum("_n").alias("_rows"))
    # A listed donor for each person of each due group: as many people at most come together.
    fit = F.floor(F.lit(BATCH_PEOPLE) / (LIST_SHARE * CHOICES * F.col("_largest") * F.col("_largest")))
    listed = F.when(LIST_SHARE * F.col("_rows") <= BATCH_PEOPLE, F.lit(min(LIST_TURNS, BATCH_TURNS))).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(min(LIST_TURNS, BATCH_TURNS)), fit)))
    kinds = shape.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("_profiles"))
    whole = (F.col("_rows") <= BATCH_PEOPLE) & (F.col("_profiles") <= WHOLE_PROFILES)
    frame = largest.join(kinds, "cohort_id").withColumn("whole", whole).select(
        "cohort_id", "whole", F.when(F.col("whole"), F.lit(BATCH_TURNS)).otherwise(listed).cast("bigint").alias("batch"))
    pending = checkpoint(flagged.withColumnRenamed("group_id", "flagged").join(frame, "cohort_id"))
    rows = base.select("cohort_id", "row_id", "group_id", "Gender", "Diversity", "profile_id").join(
        pending.select("cohort_id").distinct(), "cohort_id", "left_semi")
    rows, done = checkpoint(rows), []
    # True: some cohort is taken whole, False: some by lists.
    while modes := {r[0] for r in pending.select("whole").distinct().collect()}:
        begun = pending.groupBy("cohort_id").agg(F.min("turn").alias("_begun"))
        due = pending.join(begun, "cohort_id").where(F.col("turn") < F.col("_begun") + F.col("batch")).drop("_begun", "batch")
        decided = checkpoint(_batch(rows, due, shape, rule, modes))
        done.append(decided)
        over = decided.groupBy("cohort_id").agg(F.max("turn").alias("_over"))
        pending = checkpoint(pending.join(over, "cohort_id").where(F.col("turn") > F.col("_over")).drop("_over"))
        rows = checkpoint(_apply(rows, decided.where("in_id IS NOT NULL"), "turn").join(
            pending.select("cohort_id").distinct(), "cohort_id", "left_semi"))
    log = reduce(DataFrame.unionByName, done).where("in_id IS NOT NULL")
    return log.select("cohort_id", (F.col("turn") + turns_before).cast("int").alias("round"), "group_id", "isolation_type", "in_id",
                      "donor_group", "out_id", "dist")


def fix_gender_isolation(labelled: DataFrame, profiles: DataFrame, max_passes: int = 1,
                         max_rounds: int | None = None, strict_donor: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bring a second woman (or man) into each flagged group for somebody similar."""
    return fix_isolation(labelled, profiles, gender_rule(strict_donor), max_passes, max_rounds)


def fix_diversity_isolation(labelled: DataFrame, profiles: DataFrame, keep_genders: bool = True,
                            max_passes: int = 1, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Bring a second member of a lone category into its group; genders stay balanced on request."""
    return fix_isolation(labelled, profiles, diversity_rule(keep_genders), max_passes, max_rounds)
