"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.llm import (
    byte_bpe, jaccard_join, lexical_search, license_scan, line_crf, maxent_lm, mixing, quality_rules, sharding, suffix_dedup, toxicity,
    vector_codes, vector_file)
from evenfold.llm.labelled import held_out, training_sample
from evenfold.llm.tables import documents, remainder

def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf)).drop("node", "comp")


def op2_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf), F.array("source"))
    return mixed.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target",
                        (F.col("_mix.size") * F.col("_mix.times")).alias("taken"))


def op3_maxent_lm(spark: SparkSession, sf: str) -> DataFrame:
    return maxent_lm.score(documents(spark, sf), remainder(F.col("doc_id"), 7) == 2)


def op4_vector_file(spark: SparkSession, sf: str) -> DataFrame:
    return vector_file.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = byte_bpe.vocabulary(spark, rank_file())
    encoded = byte_bpe.encode(documents(spark, sf).select("doc_id", "text"), ranks)
    return byte_bpe.digests(encoded.select("doc_id", "ids"), ranks)


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, sf).select("doc_id", "text")))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    examples = training_sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), "toxic", toxicity.SAMPLE_ROWS)
    machine = spark.sparkContext.broadcast(toxicity.train(examples))
    scored = toxicity.with_score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.with_quality(documents(spark, sf), name="q")
    return judged.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
                         "q.base_failed", "q.kept")


def op9_line_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    field = line_crf.train(training_sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality", line_crf.SAMPLE_ROWS))
    scored = line_crf.with_score(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_byte_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.byte_shards(documents(spark, sf), 16)


def op11_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.with_licenses(documents(spark, sf).select("doc_id", "text"), name="found").select("doc_id", "found.*")


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), 50)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_jaccard_join, op2_source_mix, op3_maxent_lm, op4_vector_file, op5_byte_bpe, op6_suffix_dedup, op7_toxicity, op8_quality_rules, op9_line_crf,
    op10_byte_shards, op11_license_scan, op12_vector_codes, op13_lexical_search)}
