"""A bounded sample of labelled training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.llm.tables import remainder

FOLDS, HELD_OUT = 4, 2


def held_out(id_column: str = "doc_id"):
    return remainder(F.col(id_column), FOLDS) == HELD_OUT


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled rows outside the held-out fold, in a seeded order.

    ``rows`` bounds what reaches the driver; it is the only sampling, and it touches the fitting alone.
    Rows without an id, a label of 0 or 1, or a text are no examples.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select(
        "doc_id", F.col(label).alias("label"), F.md5(F.col("doc_id").cast("string")).alias("seat")).orderBy("seat", "label").limit(rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = F.broadcast(chosen).join(texts, "doc_id").orderBy("seat", "label", "text").limit(rows)
    return [(r["text"], int(r["label"])) for r in found.select("text", "label").collect()]
