"""Assignments and report text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.functions.text import cell, shorten
from evenfold.operators.ranking import rank_in_cohort

# The layout of the report.
RULE = 65
REPORTED = ("Name", "Gender", "Diversity", "Learning_Style")
WIDTHS = {"Name": 20, "Gender": 8, "Ethnicity": 20, "Style": 10}
TITLE = "FINAL GROUP ASSIGNMENTS REPORT"


def group_assignments(labelled: DataFrame) -> DataFrame:
    """``Group_ID`` (from 1) first, then the people's own columns."""
    helpers = ("group_id", "label", "profile_id", "run")
    rest = [c for c in labelled.columns if c not in helpers]
    return labelled.select((F.col("group_id") + 1).alias("Group_ID"), *rest)


def report_lines(assignments: DataFrame) -> DataFrame:
    """``cohort_id, group_id, line_no, line``: a heading (group 0), then a table per group.

    Members stand in name order. Wide values push their cell out instead of being cut;
    only long ethnicities are shortened.
    """
    shown = assignments.select("cohort_id", F.col("Group_ID").alias("_g"), "row_id", *REPORTED)
    rows = rank_in_cohort(shown, ["Name", "row_id"], "_nth", ("cohort_id", "_g"))
    # pandas prints an empty cell of a text column as nan.
    text = {c: F.coalesce(F.col(c), F.lit("nan")) for c in REPORTED}
    line = F.concat_ws(
        " | ", cell(text["Name"], WIDTHS["Name"]), cell(text["Gender"], WIDTHS["Gender"]),
        cell(shorten(text["Diversity"]), WIDTHS["Ethnicity"]), cell(text["Learning_Style"], WIDTHS["Style"]))
    members = rows.select(
        "cohort_id", F.col("_g").alias("group_id"),
        (F.col("_nth") + 5).cast("int").alias("line_no"), line.alias("line"))

    header = " | ".join(f"{name:<{width}}" for name, width in WIDTHS.items())
    rule = F.lit("-" * RULE)
    sizes = rows.groupBy("cohort_id", "_g").agg(F.count(F.lit(1)).alias("_n"))
    title = F.format_string(" GROUP %d (%d students)", F.col("_g"), F.col("_n"))
    frame = sizes.select(
        "cohort_id", F.col("_g").alias("group_id"),
        F.explode(F.array(*[
            F.struct(number.cast("int").alias("line_no"), text.alias("line"))
            for number, text in (
                (F.lit(1), F.lit("")), (F.lit(2), title), (F.lit(3), rule), (F.lit(4), F.lit(header)),
                (F.lit(5), rule), (F.col("_n") + 6, rule))
        ])).alias("_l")).select("cohort_id", "group_id", "_l.line_no", "_l.line")

    bar = F.lit("=" * RULE)
    heading = sizes.select("cohort_id").distinct().select(
        "cohort_id", F.lit(0).alias("group_id"),
        F.posexplode(F.array(F.lit(""), bar, F.lit(TITLE), bar)).alias("_at", "line")).select(
        "cohort_id", "group_id", (F.col("_at") + 1).alias("line_no"), "line")
    return heading.unionByName(frame).unionByName(members)
