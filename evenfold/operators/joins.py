"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.session import BROADCAST_ROWS, task_count

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 2_000_000
# Left rows of one cohort that one task pairs with the right side.
BLOCK_ROWS = 1_024


def join_by_weight(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    weight: str,
    spread: str = "row_id",
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join rows to one record per key, where ``weight`` is the key's number of rows.

    Keys heavier than ``rows_per_task`` are cut into parts: their rows take a part number
    from a hash of ``spread`` and their record is repeated once per part. There are at
    most rows / rows_per_task such keys, which is what makes their list safe to
    broadcast; all other keys join as they are. Keys compare null-safe.
    """
    parts = F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int")
    sized = small.withColumn("_parts", F.greatest(parts, F.lit(1)))
    heavy = sized.where("_parts > 1").select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_parts")
    on_heavy = _all_equal([(F.col(k), F.col(f"_h_{k}")) for k in keys])
    left = big.join(F.broadcast(heavy), on_heavy, "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), 0).otherwise(
            F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))
    ).drop("_parts", *[f"_h_{k}" for k in keys])
    renamed = [F.col(k).alias(f"_r_{k}") for k in keys]
    rest = [c for c in small.columns if c not in keys]
    right = sized.select(*renamed, *rest, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_r_part"))
    on = _all_equal([(F.col(k), F.col(f"_r_{k}")) for k in keys]) & (F.col("_part") == F.col("_r_part"))
    return left.join(right, on, how).drop("_part", "_r_part", *[f"_r_{k}" for k in keys])


def _all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    condition = F.lit(True)
    for left, right in pairs:
        condition = condition & left.eqNullSafe(right)
    return condition


def cohort_groups(df: DataFrame):
    """Grouped by cohort under columns of its own, so that relatives can be cogrouped."""
    own = df.select(*[F.col(c).alias(c) for c in df.columns])
    return own.repartition(task_count(df.sparkSession), "cohort_id").groupBy("cohort_id")


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("cohort_id",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def pair_within(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: list[str],
    left_rows: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All (left, right) pairs with equal ``keys``, streamed through an equi-join.

    ``left_rows``, a column of both sides, is how many left rows the key has. A key
    with many is cut into blocks of about ``block_rows``, each a join key of its own, so
    no task meets more than a block of left rows at once. The caller aggregates the pairs.
    """
    tasks = task_count(left.sparkSession)
    blocks = F.greatest(F.ceil(F.col(left_rows) / F.lit(block_rows)), F.lit(1)).cast("int")
    cut = left.withColumn("_block", F.pmod(F.xxhash64(*left_id), blocks).cast("int"))
    cut = cut.repartition(tasks, *keys, "_block")
    spread = right.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop(left_rows)
    return cut.join(spread, [*keys, "_block"]).drop("_block")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def two_nearest(pairs: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """First and second smallest (``value``, ``tie``) per key.

    Spark cuts the ranked window to two rows per key before the shuffle as well as after
    it, so a key with many pairs sends only two rows per task.
    """
    rank = Window.partitionBy(*keys).orderBy(value, tie)
    top = pairs.withColumn("_rank", F.row_number().over(rank)).where("_rank <= 2")
    first, second = F.col("_rank") == 1, F.col("_rank") == 2
    return top.groupBy(*keys).agg(
        F.max(F.when(first, F.col(value))).alias("first_value"),
        F.max(F.when(first, F.col(tie))).alias("first_id"),
        F.max(F.when(second, F.col(value))).alias("second_value"),
        F.max(F.when(second, F.col(tie))).alias("second_id"),
    )
