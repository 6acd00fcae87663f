"""Row numbers inside a cohort without sorting a cohort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenfold.session import checkpoint


def rank_in_cohort(
    df: DataFrame, order: list[str], name: str = "rn", by: tuple[str, ...] = ("cohort_id",)
) -> DataFrame:
    """Add ``name``: 1-based position of each row in its cohort under a total ``order``.

    The rows are range-partitioned on (cohort, order) and sorted inside each partition, so a
    cohort of any size is cut over as many tasks as its share of the data asks for. Each
    partition then counts its run of every cohort; a row's position is its place in the
    run plus the runs before it. The sorted rows are written to the checkpoint folder first,
    because places and counts must come from one and the same partitioning.
    """
    keys = list(by)
    placed = checkpoint(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy(*keys, "_slice")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_run"))
        .withColumn("_base", F.coalesce(F.sum("_run").over(before), F.lit(0)))
        .drop("_run")
    )
    return (
        placed.join(runs, [*keys, "_slice"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_base") + 1)
        .drop("_at", "_slice", "_first", "_base")
    )
