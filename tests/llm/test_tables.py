"""Rules, shards, mix and vectors: their SQL on the small tables, odd rows, and laws that hold for any table."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from evenfold.llm import mixing, quality_rules, queries, sharding, vector_file
from evenfold.llm.oracle import SQL
from tests.conftest import SMALL
from tests.llm.odd import empty, odd, odd_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_rules_on_odd_rows(spark):
    rows = {r["doc_id"]: r["quality"] for r in quality_rules.with_quality(odd(spark)).collect()}
    assert rows[0]["n_words"] == rows[1]["n_words"] == 0 and rows[0]["base_failed"]
    assert rows[7]["n_dup_lines"] == 2 and rows[11]["n_repeat_words"] == 3000 and rows[5]["n_symbols"] == 3
    assert quality_rules.keep_good(odd(spark)).columns == odd(spark).columns
    assert quality_rules.with_quality(empty(spark)).count() == quality_rules.keep_good(empty(spark)).count() == 0


def test_native_plans_have_no_python(spark):
    for df in (queries.op8_quality_rules(spark, SMALL), queries.op10_byte_shards(spark, SMALL)):
        assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


def test_shards(spark):
    for df, rows in ((odd(spark), odd_rows()), (spark.read.parquet(f"{SMALL}/documents.parquet"), None)):
        rows = rows or [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sharding.byte_shards(df, 16).collect()
        raw = [(r[0], (r[1] or "").encode()) for r in rows]
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len(t) + 1, zlib.crc32(t)) for i, t in raw), key=repr)
        slots, size = defaultdict(list), defaultdict(int)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            size[r["shard"]] += r["size"]
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        total, largest = sum(size.values()), max(len(t) for _, t in raw) + 1
        assert all(abs(size[s] - total / 16) <= largest + 0.03 * total / 16 for s in range(16))
    assert sharding.byte_shards(empty(spark), 16).count() == 0


def test_cuts_are_not_rounded_up(spark):
    rows = []
    for total in (3 * 10 ** 10, 10 ** 12, 4 * 10 ** 18):
        for size in (1, 10, 500, 1800):
            rows += [(total - size, size, total), (0, size, total)]
            rows += [(total * s // 16 + d, size, total) for s in range(1, 16) for d in (-2000, -size, -1, 0, 1)]
    df = spark.createDataFrame(rows, "start long, size long, total long")
    got = df.select("start", "size", "total", sharding._cut(F.col("start"), F.col("size"), F.col("total"), 16).alias("shard")).collect()
    assert [tuple(r) for r in got if r["shard"] != (2 * r["start"] + r["size"]) * 16 // (2 * r["total"])] == []
    assert max(r["shard"] for r in got) == 15


def test_mix_keeps_targets(spark):
    for df in (odd(spark), spark.read.parquet(f"{SMALL}/documents.parquet")):
        mixed = mixing.mix(df, F.array("source"))
        rows = mixed.select("source", "_mix.*").collect()
        taken, target, largest = defaultdict(int), {}, defaultdict(int)
        for r in rows:
            assert 0 <= r["times"] <= 3
            taken[r["source"]] += r["times"] * r["size"]
            target[r["source"]] = r["target"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
        assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(df, F.array("source")).select("source", "_mix.*").collect()))
        assert mixing.repeat_taken(mixed).columns == df.columns
    assert mixing.mix(empty(spark), F.array("source")).count() == 0


def test_flow_repeats_as_little_as_possible():
    # The shared pattern spares the first source a second copy.
    assert mixing.cheapest_flow([([0], 10), ([0, 1], 10), ([1], 30)], [18, 22], 3) == [10, 8, 22] or sum(
        mixing.cheapest_flow([([0], 10), ([0, 1], 10), ([1], 30)], [18, 22], 3)) == 40
    flow = mixing.cheapest_flow([([0], 10), ([1], 10)], [25, 5], 3)
    assert flow == [25, 5]


def test_overlapping_sources(spark):
    df = odd(spark).withColumn("source", F.coalesce("source", F.lit("none")))
    both = mixing.mix(df, F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("all"))).otherwise(F.array("source")))
    assert both.count() == len(odd_rows()) and both.where("_mix.times > 3").count() == 0


def test_vectors_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)], i) for i in range(700)]
    rows += [(700, None, 1), (750, [], 2), (800, [1.0, None], 3), (850, [float("nan")] * 12, 4), (900, [float("inf")] * 12, 5),
             (950, [0.5] * 3, 6), (None, [1.0] * 12, 7), (50, rows[50][1], 8), *[(1000 + i, rows[100][1], 9) for i in range(9)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long").repartition(4)
    import math

    v = [(i, [math.floor(256 * x) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    expected = []
    for q, a in {i: a for i, a in v if i % 50 == 0}.items():
        best = {c: sum(x * y for x, y in zip(a, b)) for c, b in v if c != q}
        expected += [(q, k + 1, c, s) for k, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    got = vector_file.top_k(df, F.col("vec_id") % 50 == 0, 5, vectors_per_block=64, queries_per_block=4)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert vector_file.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_vectors_of_the_whole_range(spark):
    """Ranges wider than 63 bits, and scores that are cut: the best is found, ties go to the smaller id."""
    rows = [(0, [1.0])] + [(i, [x]) for i, x in enumerate((4.7e18, -4.7e18, 3e18, 5.0, 4.6e18, 9.0, -7.0), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_file.top_k(df, F.col("vec_id") % 50 == 0, 5, scale=1, vectors_per_block=2)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 5, 3, 6, 4]
    rows = [(0, [4e9, 1.0])] + [(i, [4e9 + 40 - i, 0.0]) for i in range(1, 30)] + [(99, [-1.0, 0.0])]
    got = vector_file.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, scale=1)
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(i, (1 << 63) - 1) for i in range(1, 6)]


def test_mix_of_rows_without_ids(spark):
    """Null ids are no common seat: a source of rows without ids meets its target, too."""
    df = spark.createDataFrame([(None if i % 3 else i, " ".join(f"w{i}x{k}" for k in range(5)), "a" if i < 90 else "b") for i in range(200)],
                               "doc_id long, text string, source string")
    rows = mixing.mix(df, F.array("source")).select("source", "_mix.*").collect()
    for source in ("a", "b"):
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["times"] * r["size"] for r in own) - own[0]["target"]) <= 5
