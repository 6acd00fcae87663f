"""Contiguous balanced shards from global prefix sums of byte sizes.

Rows are range-partitioned on (hash of the text, id), which spreads a text of many copies over as
many tasks as it needs. Each partition sums its own bytes and rows; the prefix sums of these
totals, one row per partition, give every row its global byte position. Shards are equal
cuts of the total. Rows of one text stay on one side of a cut unless they hold more than
``whole`` of a shard; such a text is cut between rows, so shards stay near equal.

Null text has no bytes. Null ids and repeated rows are rows like any other; rows alike in id and
text may trade places. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.llm.tables import Workspace


def byte_shards(df: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text", whole: float = 0.02) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (gapless per shard), grown_shard (null)."""
    work = Workspace(df.sparkSession, "shards")
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("h"))
    order = ["h", "text_crc32", "doc_id"]
    placed = work.write(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    totals = placed.groupBy(part.alias("part")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # One row per partition: the only rows that meet in one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("part", part)
    prefix = (
        summed.withColumn("own_bytes", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(F.broadcast(base), "part")  # as many rows as partitions
        .select("doc_id", "size", "text_crc32", "h", "total", (F.col("own_bytes") + F.col("base_bytes")).alias("start"),
                (F.col("at") - F.shiftleft(F.col("part"), 33) + F.col("base_n")).alias("at")))
    prefix = work.write(prefix, "prefix")
    groups = prefix.groupBy("h", "text_crc32").agg(F.min("start").alias("g_start"), F.sum("size").alias("g_size"))
    small = F.col("g_size") * shards <= F.col("total") * F.lit(whole)
    cut = prefix.join(groups, ["h", "text_crc32"]).withColumn(
        "shard", _cut(F.when(small, F.col("g_start")).otherwise(F.col("start")),
                      F.when(small, F.col("g_size")).otherwise(F.col("size")), F.col("total"), shards))
    cut = work.write(cut.select("doc_id", "size", "text_crc32", "at", "shard"), "cut")
    first = cut.groupBy("shard").agg(F.min("at").alias("first"))
    return cut.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def _cut(start: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard whose byte range holds the middle of [start, start + size); whole numbers only, so nothing is rounded up."""
    middle = (2 * start + size).cast("decimal(27,0)")
    return F.call_function("div", middle * F.lit(shards).cast("decimal(10,0)"), (2 * total).cast("decimal(27,0)")).cast("int")
