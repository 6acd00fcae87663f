from __future__ import annotations

import random

import numpy as np
import pytest

from evenfold.llm.jaccard_join import Likeness, compact, filed_keys, folded, jaccard_join, keep_one, sketch
from tests.llm.brute import jaccard_components
from tests.llm.odd import empty, odd, odd_rows


def _group(seed: int) -> list[str]:
    """Chains and clouds of near copies around the threshold, and texts that share long passages only."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(10_000))
    texts = []
    for size in (8, 30, 120, 400):
        base = [word() for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(1 + size // 25)):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
        walk = list(base)
        for _ in range(12):
            for _ in range(1 + size // 80):
                walk[rng.randrange(size)] = word()
            texts.append(" ".join(walk))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,like,block", [(1, Likeness(), 1024), (2, Likeness(5, 80, 100), 7)])
def test_matches_all_pairs(spark, seed, like, block):
    texts = _group(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join(df, like=like, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_components(texts, like.width, like.num, like.den)


def test_linked_sets_share_a_filed_word():
    rng, like = np.random.default_rng(0), Likeness()
    for n in (7, 20, 60, 300, 3000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a.copy()
            gone = like.difference(n) // 2
            b[rng.choice(n, gone, replace=False)] = rng.integers(0, 1 << 63, gone, dtype=np.uint64)
            b = np.unique(b[rng.permutation(n)[:n - (like.difference(n) - 2 * gone)]])
            common = len(np.intersect1d(a, b))
            if like.links(common, len(a), len(b)) and common < max(len(a), len(b)):
                assert set(filed_keys(a, like)) & set(filed_keys(b, like))
                apart = np.bitwise_count(folded(compact(a), 16) ^ folded(compact(b), 16)).sum()
                assert apart <= len(a) + len(b) - 2 * common
    assert (folded(sketch(a, 128), 32) == sketch(a, 32)).all()


def test_odd_rows(spark):
    rows = odd_rows()
    got = jaccard_join(odd(spark)).collect()
    assert len(got) == len(rows)
    expected = jaccard_components([r[1] for r in rows])
    least: dict[int, list] = {}
    for i, r in enumerate(rows):
        least.setdefault(expected[i], []).append(r[0])
    groups = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    wordless = {r[0] for r in rows if not (r[1] or "").strip(" \t\n")}
    want = sorted(((r[0], groups[expected[i]]) for i, r in enumerate(rows)), key=repr)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == want
    assert {r["doc_id"] for r in got if r["n_shingles"] == 0} == wordless
    kept = keep_one(odd(spark), Likeness()).collect()
    assert len(kept) == len({e for i, e in enumerate(expected) if (rows[i][1] or "").strip(" \t\n")}) + sum(
        not (r[1] or "").strip(" \t\n") for r in rows)


def test_keep_one_among_clashing_names_and_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text if i % 3 else text + " more", i, i) for i in range(9, 60)] + [(None, text, 0, 0), (9, text, 1, 1), (3, " ", 7, 7), (None, None, 8, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node long, _id long").repartition(5)
    kept = keep_one(df, Likeness(5, 80, 100))
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], bool((r["text"] or "").strip())) for r in kept.collect()), key=repr)
    assert got == sorted([(9, True), (3, False), (None, False)], key=repr)
    assert all(r["_node"] in (1, 7, 8, 9) for r in kept.collect())


def test_empty_table(spark):
    assert jaccard_join(empty(spark)).count() == 0 and keep_one(empty(spark), Likeness()).count() == 0
