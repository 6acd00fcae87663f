"""The stages of the corpus pipeline: each applies one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.llm import byte_bpe, jaccard_join, mixing, suffix_dedup
from evenfold.llm import quality_rules as rules
from evenfold.llm.queries import rank_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by four fifths of their five-word shingles."""
    return jaccard_join.keep_one(docs, jaccard_join.Likeness(5, 80, 100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages of 400 bytes that occur elsewhere; n_chars follows."""
    return _rest(docs, suffix_dedup.remove_repeats(docs, characters=True))


def repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As ``repeated_passages``, and without runs of 50 words that occur elsewhere, which may be shorter."""
    return _rest(docs, suffix_dedup.remove_repeats(docs, characters=True, run_words=50))


def _rest(docs: DataFrame, cut: DataFrame) -> DataFrame:
    gone = F.size("_cut.removed") > 0
    text = F.when(gone, F.col("_cut.kept").cast("string")).otherwise(F.col("text"))
    chars = F.when(gone, F.length(F.col("_cut.kept").cast("string"))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[{"text": text, "n_chars": chars}.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_taken(mixing.mix(docs, F.array("source")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, byte_bpe.vocabulary(spark, rank_file()))
