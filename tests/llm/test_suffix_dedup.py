from __future__ import annotations

import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenfold.llm import spans
from evenfold.llm.suffix_dedup import _batches, _contexts, _indexed, _packed, _repeated, _row_anchors, anchors, digest, remove_repeats, repeated_spans
from evenfold.llm.tables import Workspace
from evenfold.llm.spans import SpanHash
from tests.llm.brute import suffix_digest


def _texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéf") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60 + 30 * k) for k in range(4)]
    texts: list[str | None] = [None, "", "a", "x" * 399, "y" * 400, "z" * 401, "ab" * 700, "z" * 380, prose(400), prose(5)]
    texts += [texts[8], "x" * 399]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(prose(rng.randrange(40)))
            passage = rng.choice(shared)
            a = rng.randrange(len(passage) // 3)
            parts.append(passage[a:a + rng.choice((150, 300, 399, 405, 500, 2000))])
        texts.append("".join(parts))
    base = prose(250)
    for _ in range(25):
        words = base.split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed,limit", [(1, 8000), (2, 8000), (3, 4)])
def test_matches_a_table_of_all_windows(spark, seed, limit):
    texts = _texts(seed)
    df = spark.createDataFrame([(i, t, "k", None) for i, t in enumerate(texts)], "doc_id long, text string, key string, spans string").repartition(5)
    rows = digest(remove_repeats(df, group_limit=limit)).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in rows}
    expected = suffix_digest(texts)
    assert len(rows) == len(texts)
    assert [i for i in range(len(texts)) if got[i] != expected[i]] == []
    assert sum(e[1] for e in expected) > 10_000


def test_empty_table(spark):
    assert digest(remove_repeats(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_segments_of_long_texts_change_no_anchor():
    rng = random.Random(4)
    raws = [bytes(rng.randrange(97, 123) for _ in range(9000)), b" " * 3000, b"abc" * 10, b"", bytes(rng.randrange(97, 99) for _ in range(2500))]
    buf, offs = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    whole = list(zip(*(np.concatenate(c).tolist() for c in zip(*_row_anchors(buf, offs, 400)))))
    for segment in (90, 250, 601, 4000):
        assert list(zip(*(np.concatenate(c).tolist() for c in zip(*_row_anchors(buf, offs, 400, segment))))) == whole


@pytest.mark.parametrize("limit", [8000, 4])
def test_edges_of_segments_are_no_repeats(spark, limit):
    texts = _texts(5)
    texts += ["".join(random.Random(i).choices("abcdefgh", k=6000)) for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in digest(remove_repeats(df, group_limit=limit, segment=300)).collect()}
    expected = suffix_digest(texts)
    assert [i for i in range(len(texts)) if got[i] != expected[i]] == []
    assert [e[1] for e in expected[-3:]] == [0, 0, 0]


def test_runs_inside_one_text_are_few_contexts(spark):
    df = spark.createDataFrame([(" " * 100_000,), ("0123456789" * 10_000 + "!",)], "text string")
    hits = _repeated(_indexed(df, "text", 400)).groupBy("tid").agg(F.collect_set("key").alias("keys"))
    rows = _contexts(_packed(df, "text").join(hits, "tid"), 400)
    size = rows.select(F.sum(F.octet_length("around")), F.sum(F.size("p")), F.max(F.size("p"))).first()
    assert size[0] < 2_000_000 and size[1] > 100_000 and size[2] <= 1024


def test_grams_frequent_in_one_text_are_heavy(spark):
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh", k=450))
    many = "".join(passage[rng.randrange(30):] + "".join(rng.choices("xyz", k=rng.randrange(60))) for _ in range(40))
    texts = [many, " " * 3000, "no repeat " + "".join(rng.choices("abcdefgh", k=900)), "=" * 2000 + many[:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    work = Workspace(spark, "heavy")
    repeated_spans(df, "text", 400, work, 20).collect()
    assert os.path.isdir(f"{work.root}/parts".removeprefix("file:"))  # written for heavy grams only
    expected = suffix_digest(texts)
    for segment in (300, 1 << 22):
        got = {r["doc_id"]: tuple(r)[1:] for r in digest(remove_repeats(df, group_limit=20, segment=segment)).collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_texts_that_fool_polynomial_hashes_stay(spark):
    """Letters in the pattern of bit parity, and swapped: different texts without a repeat of 400 bytes."""
    first = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    texts = [first, first.translate(str.maketrans("ab", "ba")), "x" * 50 + first[:300] + "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in digest(remove_repeats(rows)).collect()}
    assert [got[i] for i in range(3)] == suffix_digest(texts)


def test_spans_of_one_buffer_hash_alike_only_if_equal():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 100, 400).astype(np.uint8)
    starts = rng.integers(0, 400, 3000)
    ends = np.minimum(400, starts + rng.integers(0, 9, 3000))
    names = SpanHash(buf, seed=3)(starts, ends).tolist()
    raw = [buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    assert len(set(zip(names, raw))) == len(set(names)) == len(set(raw))


def test_powers_of_a_large_buffer_are_not_kept():
    buf = np.random.default_rng(1).integers(97, 123, spans.KEPT_POWERS + 5_000, dtype=np.uint8)
    buf[-3_000:] = buf[:3_000]
    large = spans.SpanHash(buf, seed=5)
    ends = np.array([3_000, len(buf)])
    first, last = large(ends - 3_000, ends)
    assert first == last == spans.SpanHash(buf[:3_000], seed=5)(np.array([0]), np.array([3_000]))[0]
    assert all(len(x) <= spans.KEPT_POWERS for x in spans._POWERS)


def _without_runs(texts: list[str | None], length: int, run: int) -> list[str]:
    """Texts without characters that a repeat of ``length`` bytes or of ``run`` words covers, from tables of all windows."""
    found = [(m.span(), m.group()) for t in texts for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
    rows = np.cumsum([0, *(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)]).tolist()
    own = [found[a:b] for a, b in zip(rows[:-1], rows[1:])]
    runs = Counter(tuple(w for _, w in f[x:x + run]) for f in own for x in range(len(f) - run + 1))
    strings = Counter((t or "")[x:x + length] for t in texts for x in range(len(t or "") - length + 1))
    out = []
    for t, f in zip(texts, own):
        t, gone = t or "", set()
        covered = {y for x in range(len(f) - run + 1) if runs[tuple(w for _, w in f[x:x + run])] > 1 for y in range(x, x + run)}
        for y in covered:  # white space goes where the words on both sides do
            gone |= set(range(f[y][0][0], f[y + 1][0][0] if y + 1 in covered else f[y][0][1]))
        for x in range(len(t) - length + 1):
            if strings[t[x:x + length]] > 1:
                gone |= set(range(x, x + length))
        out.append("".join(c for i, c in enumerate(t) if i not in gone))
    return out


@pytest.mark.parametrize("limit", [8000, 4])
def test_short_runs_of_words_go_too(spark, limit):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(n))
    passages = [prose(n) for n in (49, 50, 51, 55, 60, 140)]
    texts = [None, "", "a " * 49, "b " * 50, "c " * 80, "x" * 500, prose(60), "y" * 390]
    texts += [texts[6], " ".join(["z"] * 50), "same " + prose(30), "y" * 390]
    for k in range(24):
        passage = passages[k % 6].replace(" ", rng.choice((" ", "\n", "  ")))
        texts.append(f"{prose(rng.randrange(60))}{rng.choice((' ', chr(10)))}{passage} {prose(rng.randrange(60))}")
    texts.append("".join(texts[12:]))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    expected = _without_runs(texts, 400, 50)
    cut = remove_repeats(df, group_limit=limit, run_words=50, characters=True).select("doc_id", F.col("_cut.kept").cast("string").alias("kept"))
    got = {r["doc_id"]: r["kept"] for r in cut.collect()}
    assert [i for i in range(len(texts)) if got[i] != expected[i]] == []
    stage = dict(corpus_pipeline.STAGES)["repeated passages"](spark, df, "")
    got = {r["doc_id"]: (r["text"] or "", r["n_chars"]) for r in stage.collect()}
    assert {i: (got[i], expected[i]) for i in range(len(texts)) if got[i] != (expected[i], len(expected[i]))} == {}


def test_windows_are_hashed_as_spans_in_less_memory():
    buf = np.random.default_rng(3).integers(0, 256, 300_000).astype(np.uint8)
    for k in (1, 2, 200, 299_999, 300_000, 300_001):
        at = np.arange(max(0, len(buf) - k + 1))
        assert np.array_equal(spans.SpanHash(buf, seed=5).windows(k), spans.SpanHash(buf, seed=5)(at, at + k))
    batch = pa.record_batch([pa.array(["x" * 100_000] * 30)], names=["text"])
    assert [b - a for a, b, _, _ in _batches(batch)] == [5] * 6
    tracemalloc.start()
    anchors(buf, np.array([0, len(buf)]), 400)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * len(buf)
