"""A corpus from raw documents: rules, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
back as the next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenfold.llm import stages
from evenfold.llm.tables import Workspace, documents

STAGES = [
    ("quality rules", stages.quality_rules),
    ("near duplicates", stages.near_duplicates),
    ("repeated passages", stages.repeated_runs),
    ("source mix", stages.source_mix),
    ("token ids", stages.token_ids),
]

#: Suffix sorting and byte pair merges have no SQL form: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{at}")
    return docs
