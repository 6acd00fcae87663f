"""A small table with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, node long, spans string, "
          "score string, quality string, ids string, _row string, chunk string")


def odd_rows(n: int = 60) -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "Word", "naïve", "x1", "don't", "Éa", "漢字", "runner", "tree", "stone", "river", "idiot"]
    prose = lambda k: " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(k))
    base = prose(150)
    texts = [None, "", " \n\t ", "one", "two words", "###", "a" * 5000, "line\nline\nline\n", base, base, prose(3000), "ab " * 3000,
             "i d i o t you", "\x00\x1c\x85 odd  é", "🎉" * 300]
    for k in range(n - len(texts)):
        words = base.split(" ") if k % 3 == 0 else prose(80).split(" ")
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, "en", None if i % 11 == 3 else f"src{i % 4}", None, "k", i, "s", None, "q", "z", "r", "c") for i, t in enumerate(texts)]
    rows += [(None, base, None, None, 1, None, None, None, None, None, None, None, None), (None, None, *[None] * 11),
             rows[8], rows[8], (9, "other text for a repeated id", *rows[9][2:])]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
