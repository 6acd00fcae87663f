from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenfold.llm import line_crf, maxent_lm, queries, toxicity
from evenfold.llm.tables import remainder
from tests.conftest import SMALL
from tests.llm.odd import empty, odd, odd_rows

FOLD = {"toxic": (queries.op7_toxicity, 0.3), "quality": (queries.op9_line_crf, 0.7)}
MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("label,least", [("toxic", 0.9), ("quality", 0.97)])
def test_held_out_accuracy(spark, label, least):
    query, threshold = FOLD[label]
    scored = query(spark, MEDIUM)
    assert dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = scored.join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least


def test_gaps_do_not_hide_an_insult():
    bad = [f"some words here and you {w} with more words {i}" for i, w in enumerate(["idiot", "stupid", "moron"] * 12)]
    fine = [f"some words here and you friend with more words {i}" for i in range(80)]
    machine = toxicity.train([(t, 1) for t in bad] + [(t, 0) for t in fine])
    import pyarrow as pa

    from evenfold.llm.spans import utf8
    scores = machine.scores(*utf8(pa.array(["an i d i o t here", "st.u.pid words", "a mooron", "more words here", "", None])))
    assert min(scores[:2]) > 0.5 and scores[2] > 2 * scores[3] and max(scores[3:]) < 0.3


def test_models_on_odd_rows(spark):
    field = line_crf.train([("good line\nother line", 1), ("BAD!! BAD!!\n### ###", 0)] * 8, steps=30)
    assert line_crf.with_score(odd(spark), field).where("score BETWEEN 0 AND 1").count() == len(odd_rows())
    machine = spark.sparkContext.broadcast(toxicity.train([("an idiot", 1), ("a friend", 0)] * 8))
    assert toxicity.with_score(odd(spark), machine).where("score BETWEEN 0 AND 1").count() == len(odd_rows())
    assert line_crf.with_score(empty(spark), field).count() == toxicity.with_score(empty(spark), machine).count() == 0
    # One label, or none, is no reason to fail.
    assert 0 < line_crf.train([]).scores(*__import__("evenfold.llm.spans", fromlist=["utf8"]).utf8(__import__("pyarrow").array(["x"])))[0] < 1
    assert toxicity.train([("a", 0)]).curve[2] < 0


def _plain_base(rows):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*words.findall((t or "").translate(lower)), None] for _, t in rows]
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, distinct = sum(count.values()), len(count)
    return [(i, h, len(t), sum(count[w] > 0 for w in t), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t))
            for (i, _), t, h in zip(rows, tokens, held)]


@pytest.mark.parametrize("odd_table", [True, False])
def test_language_model_base_and_gain(spark, odd_table):
    df = odd(spark) if odd_table else spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = maxent_lm.score(df, remainder(F.col("doc_id"), 7) == 2, rounds=1).collect()
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(_plain_base(rows), key=key), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5]) and g[6] < 0
    if not odd_table:
        for fold in (True, False):
            own = [r for r in got if r["held_out"] == fold]
            assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_language_model_on_an_empty_table(spark):
    assert maxent_lm.score(empty(spark), F.lit(False)).count() == 0


def test_training_has_several_rounds_and_all_classes(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        w = [rng.randrange(60)]
        for _ in range(80):
            w.append((w[-1] * 7 + 3) % 60 if rng.random() < 0.8 else rng.randrange(60))
        rows.append((i, " ".join(f"{chr(97 + x % 26)}{x}" for x in w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 5 == 0
    total = lambda scored: scored.where("held_out").agg(F.sum("score")).first()[0]
    once, default = total(maxent_lm.score(df, held, rounds=1)), total(maxent_lm.score(df, held))
    assert default > once + 1 and maxent_lm.ROUNDS > 1 and maxent_lm.CLASSES == 64


def test_chances_and_their_sums_are_those_of_single_tokens():
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 3, (maxent_lm.CLASSES, maxent_lm.ROWS)).astype(np.float32)
    bias = rng.normal(0, 40, maxent_lm.CLASSES).astype(np.float32)
    f = rng.integers(0, maxent_lm.ROWS, (maxent_lm.FEATURES, 3_000))
    f[0, 500:] = 7  # one row takes most tokens
    f[1, :40] = f[0, :40]  # and a token may have a row twice
    s = sum(weights[:, rows].astype(float) for rows in f) + bias[:, None]
    expected = np.exp(s - s.max(axis=0))
    expected /= expected.sum(axis=0)
    chance = maxent_lm._chance(weights, bias, f)
    assert np.allclose(chance, expected, rtol=1e-3, atol=1e-6) and np.allclose(chance.sum(axis=0), 1, atol=1e-5)
    table, plain = np.full(weights.shape, 2.0 ** 25), np.full(weights.shape, 2.0 ** 25)
    maxent_lm._add_chances(table, f, chance)
    for t in range(f.shape[1]):
        for row in f[:, t]:
            plain[:, row] += chance[:, t]
    assert np.allclose(table - 2.0 ** 25, plain - 2.0 ** 25, rtol=1e-6, atol=1e-5)  # next to 2^25 single precision drops them
