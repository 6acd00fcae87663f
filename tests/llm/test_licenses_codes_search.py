"""License scans, vector codes and lexical search against plain versions, on odd and random inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenfold.llm import lexical_search, license_scan, vector_codes
from evenfold.llm.terms import term_lists
from tests.llm.odd import empty, odd, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_terms_do_not_depend_on_pieces():
    for row in odd_rows():
        for piece in (1, 7, 1 << 20):
            found = [t.decode() for terms in term_lists(None if row[1] is None else row[1].encode(), piece) for t in terms]
            assert found == plain_terms(row[1])


# --- licenses

def test_regions_of_a_template():
    t = "Use <<beginOptional>>it <<beginOptional>>very <<endOptional>>freely <<endOptional>>under <<alt;match=the A B|C>> <<var;match=1-2>> license"
    run = license_scan.Automaton([t]).run
    for text, ok in [("use under c x license", 1), ("Use it freely, under the a-b x y license", 1), ("use it very freely under c x license", 1),
                     ("use very freely under c x license", 0), ("use under c license", 0), ("use under c x y z license", 0),
                     ("use under the a x license", 0), ("x use under c license license", 1), ("use use under c use use license.", 1)]:
        assert len(run(term_lists(text.encode()))[1]) == ok, text


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a<<endOptional>>", "<<var;match=x>>", "<<odd>>", "<<beginOptional>>a<<endOptional>>", "<<var;match=0-3>>"])
def test_broken_markup_is_refused(bad):
    with pytest.raises(ValueError):
        license_scan.Automaton([bad])


def as_regex(parts) -> str:
    out = ""
    for part in parts:
        if isinstance(part, license_scan.Words):
            out += "".join(f" {w}" for w in part.words)
        elif isinstance(part, license_scan.Gap):
            out += f"(?: [^ ]+){{{part.least},{part.most}}}"
        else:
            out += f"(?:{'|'.join(as_regex(r) for r in part.runs)})"
    return out


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_automaton_against_regular_expressions(most, monkeypatch):
    monkeypatch.setattr(license_scan.Automaton, "MOST_STATES", most)  # states are forgotten at any moment
    templates = ["a<<var;match=0-3>>b", "a b<<beginOptional>> a<<endOptional>> c", "<<var;match=1-2>>c c", "b <<alt;match=a a|c b a>> b", "a a a"]
    automaton, rng = license_scan.Automaton(templates), random.Random(most)
    for _ in range(300):
        words = [rng.choice("abcx") for _ in range(rng.randrange(14))]
        text = "".join(f" {w}" for w in words) + " "
        n, found = automaton.run(iter([[w.encode() for w in words[:5]], [w.encode() for w in words[5:]]]))
        assert n == len(words)
        assert set(found) == {k for k, t in enumerate(templates) if re.search(as_regex(license_scan.parse(t)) + "(?= )", text)}


def test_license_scan_on_odd_rows(spark):
    rng = random.Random(2)
    notice = "Licensed under the Apache License, Version 2.0; (MIT-License) mit MIT License! gnu general public, LICENSE"
    texts = [r[1] for r in odd_rows()] + [notice, "x " * 600_000 + notice, "mit license " * 5, "Permission is hereby granted", "licence mit é license",
                                          " ".join(rng.choice(["mit", "license", "apache", "general", "public", "gnu"]) for _ in range(3000))]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, found string").repartition(3)
    got = {r["doc_id"]: r for r in license_scan.with_licenses(df, name="licenses").collect()}
    phrases = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
    for i, t in enumerate(texts):
        words, places, labels = plain_terms(t), [], set()
        for label, phrase in phrases:
            p = phrase.split()
            starts = [s for s in range(len(words) - len(p) + 1) if words[s:s + len(p)] == p]
            places += starts
            labels |= {label} if starts else set()
        r = got[i]["licenses"]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) if labels else True
        assert 0 <= r["score"] <= 1 and got[i]["text"] == t and got[i]["found"] == "n"
    assert got[len(odd_rows())]["licenses"]["labels"] == got[len(odd_rows()) + 1]["licenses"]["labels"] == "apache,apache-2.0,gpl,mit"
    assert license_scan.with_licenses(odd(spark), name="score").columns == [*[c for c in odd(spark).columns if c != "score"], "score"]
    assert license_scan.with_licenses(empty(spark)).count() == 0


# --- vector codes

def plain_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    """Codes over all distances, in whole numbers of any size."""
    kept = [(i, lab, [max(-(1 << 62), min(1 << 62, math.floor(x * scale))) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, _, v in kept), default=0) // parts) * parts
    kept = sorted(((i, lab, v + [0] * (dims - len(v))) for i, lab, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = dims // parts
    books = [[v[p * d:p * d + d] for _, _, v in kept[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, _, v in kept:
                own[near(p, v[p * d:p * d + d])[1]].append(v[p * d:p * d + d])
            moved.append([[sum(c) // len(c) for c in zip(*xs)] if xs else e for xs, e in zip(own, books[p])])
        books = moved
    found = [(i, lab, [near(p, v[p * d:p * d + d]) for p in range(parts)]) for i, lab, v in kept]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = {}
    for _, lab, f in found:
        error[lab] = error.get(lab, 0) + sum(x[0] for x in f)
    cut = lambda x: min(x, (1 << 63) - 1)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), cut(sum(x[0] for x in f)), cut(error[lab]), sha) for i, lab, f in found), key=repr)


def vectors(kind):
    rng = random.Random(kind)
    if kind == "wide":
        return [(i, i % 3, [rng.choice([1e30, -1e30, 3e14, 1e9, 0.5]) * rng.random() for _ in range(16)]) for i in range(120)]
    if kind == "few":
        return [(i, None, [rng.gauss(0, 1) for _ in range(5 - i % 2)]) for i in range(7)] + [(99, 1, [])]
    if kind == "none":
        return [(1, 2, None), (2, 2, [None]), (3, 2, [])]
    rows = [(i, None if i % 7 == 0 else i % 4, [round(rng.gauss(0, 1), 2) for _ in range(24)]) for i in range(400)]
    rows += [(3, 1, rows[3][2]), (3, 1, rows[3][2]), (None, 1, [0.1] * 24), (500, 1, None), (501, 1, [1.0, None]), (502, 1, [float("nan")] * 24),
             (503, 1, [float("-inf")] * 24), (504, None, [0.5] * 3), *[(600 + i, 2, [0.25] * 24) for i in range(300)]]
    return rows


@pytest.mark.parametrize("kind", ["odd", "wide", "few", "none"])
def test_codes_against_all_distances(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, code string, _label int").repartition(3)
    got = vector_codes.compress(df, per_block=64)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows)
    assert vector_codes.compress(df.limit(0)).count() == 0


def test_masks_leave_no_near_entry_out():
    rng = np.random.default_rng(4)
    for n, d in ((16, 8), (64, 3), (1, 2), (5, 1)):
        entries = rng.integers(-20, 20, (n, d))
        entries[-1] = entries[0]  # a tie: the lower index
        x = rng.integers(-30, 30, (500, d))
        index, least = vector_codes.Slices(entries).nearest(x)
        far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
        inside = (np.abs(x[:, None, :] - entries[None]) <= 9).all(axis=2) @ (np.uint64(1) << np.arange(n, dtype=np.uint64))
        assert (vector_codes.Slices(entries).candidates(x, np.full(500, 9)) == inside).all()


# --- lexical search

def plain_search(docs, items, k):
    found = [(i, plain_terms(t)) for i, t in docs]
    found = [(i, w) for i, w in found if w]
    n, total = len(found), sum(len(w) for _, w in found)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in found) + 1))) for t in terms}
        scored = []
        for i, w in found:
            m = 100 - 50 + 50 * len(w) * n // total
            s = sum(weight[t] * (1000000000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in terms)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,block_bytes", [(50, 1 << 24), (3, 1500)])
def test_search_against_all_scores(spark, k, block_bytes):
    rng = random.Random(k)
    items = [(i, " ".join(rng.choice(odd_rows()[18][1].split(" ")) for _ in range(12))) for i in range(9)]
    items += [(None, "the of runner"), (9, None), (10, ""), (0, "idiot tree3"), (11, "nowhere Éa"), (12, odd_rows()[8][1]), (12, odd_rows()[8][1])]
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = lexical_search.search(odd(spark), asked, k, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search([(r[0], r[1]) for r in odd_rows()], items, k)
    if k == 3:
        assert lexical_search.search(empty(spark), asked, k).count() == lexical_search.search(odd(spark), asked.limit(0), k).count() == 0


def test_accumulators_are_limited_and_exact():
    """Every document that reaches the threshold or the k best comes out with its whole score, with many ties."""
    rng = np.random.default_rng(6)
    size, n_terms, created = 600, 9, []
    for trial in range(60):
        tf = rng.integers(0, 3, (size, n_terms)) * (rng.random((size, n_terms)) < np.linspace(0.01, 0.9, n_terms))
        tf = tf.astype(np.int64)
        term, doc = np.nonzero(tf.T)
        scoring = lexical_search.Scoring.fit(size, size * 40, (tf > 0).sum(axis=0))
        starts = np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int64)
        known = np.flatnonzero(np.diff(starts)).astype(np.int32)
        chunk = lexical_search.Chunk(np.full(size, 40).tobytes(), known.tobytes(), np.append(starts[known], len(term)).astype(np.int64).tobytes(),
                                     doc.astype(np.int32).tobytes(), tf[doc, term].astype(np.int32).tobytes(), scoring)
        exact = sum(scoring.weight[t] * np.where(tf[:, t] > 0, scoring.impacts(tf[:, t], np.full(size, 100)), 0) for t in range(n_terms))
        order = np.argsort(-scoring.weight, kind="stable")
        for k, threshold in ((1, 0), (20, 0), (20, int(np.sort(exact)[-20])), (5, int(exact.max()) + 1)):
            docs, scores = chunk.best(order, k, threshold)
            assert (scores == exact[docs]).all()
            kth = max(threshold, 1, int(np.sort(exact)[-k]))
            assert set(np.flatnonzero(exact >= kth)) <= set(docs.tolist())
            created.append(len(docs))
    assert min(created) < size / 4  # most documents never have an accumulator
