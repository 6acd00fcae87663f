"""The pipeline's stages against plain versions, each on what the stage before kept."""

from __future__ import annotations

import re

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from evenfold.llm import byte_bpe, stages
from evenfold.llm.queries import rank_file
from tests.conftest import SMALL
from tests.llm.brute import jaccard_components, suffix_digest
from tests.llm.odd import SCHEMA, odd_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    good = stages.quality_rules(spark, docs, SMALL)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()

    kept = stages.near_duplicates(spark, good.cache(), SMALL).cache()
    rows = sorted(_rows(good))
    groups = jaccard_components([r[1] for r in rows], 5, 80, 100)
    assert sorted(_rows(kept)) == [r for i, r in enumerate(rows) if groups[i] == i]

    cut = stages.repeated_passages(spark, kept, SMALL).cache()
    rows, after = sorted(_rows(kept)), sorted(_rows(cut))
    for (_, removed, _, _), before, now in zip(suffix_digest([r[1] for r in rows]), rows, after, strict=True):
        assert now[0] == before[0] and len(before[1].encode()) - removed - len(now[1].encode()) in range(4 * 8)
        assert removed or now == before

    mixed = stages.source_mix(spark, cut, SMALL).cache()
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().where("count > 3").isEmpty()
    total, before = (d.agg(F.sum(words)).first()[0] for d in (mixed, cut))
    assert abs(total - before) < 0.1 * before

    ids = stages.token_ids(spark, mixed, SMALL)
    tokens = byte_bpe.read_ranks(rank_file())
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert all(list(r["ids"]) == library.encode_ordinary(r["text"] or "") for r in ids.collect())


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in odd_rows()], SCHEMA).repartition(3)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert set(docs.columns) <= set(out.columns)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        out.count()


def test_run_gives_ids(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*COLUMNS, "ids"] and out.count() > 50
    assert not re.search("localCheckpoint", open(corpus_pipeline.__file__).read())
