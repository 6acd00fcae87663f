"""Where results go: assignment files, report text, comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_assignments(assignments: DataFrame, path: str, file_format: str = "csv", mode: str = "error") -> None:
    """One folder per cohort, rows in (Group_ID, Name) order, with a header.

    Files are cut by range, so a large cohort is written by many tasks and the names
    of its files keep the order.
    """
    order = ["cohort_id", "Group_ID", "Name", "row_id"]
    laid_out = assignments.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = laid_out.write.mode(mode).partitionBy("cohort_id")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(file_format).save(path)


def write_report(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Report text, one folder per cohort."""
    order = ["cohort_id", "group_id", "line_no"]
    laid_out = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    laid_out.select("cohort_id", "line").write.mode(mode).partitionBy("cohort_id").text(path)


def write_comparison(table: DataFrame, path: str, mode: str = "error") -> None:
    """The comparison table as CSV with a header."""
    table.write.mode(mode).option("header", True).csv(path)
