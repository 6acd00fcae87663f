"""Connected components of an edge table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.llm.tables import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); ``comp`` is the least node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label,
    so path lengths shrink geometrically. Rounds are written, and only a count reaches the driver.
    """
    both = work.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = work.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{name}-0")
    at = 0
    while True:
        at += 1
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        stepped = labels.join(seen, F.col("node") == F.col("a")).select(
            "node", F.col("comp").alias("old"), F.least("comp", "least").alias("next"))
        known = labels.select(F.col("node").alias("next"), F.col("comp").alias("further"))
        labels = work.write(stepped.join(known, "next", "left").select(
            "node", "old", F.least("next", F.coalesce("further", "next")).alias("comp")), f"{name}-{at}")
        if labels.where("comp < old").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
        if at > 1:
            work.drop(f"{name}-{at - 1}")
