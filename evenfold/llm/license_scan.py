"""License scans by template markup, compiled into one token automaton.

A template is mandatory wording with regions: ``<<beginOptional>> ... <<endOptional>>`` may be left out as a whole,
``<<var;match=a-b>>`` stands for any a to b words, ``<<alt;match=x|y>>`` for one of several wordings. Only words
count, so case, punctuation, comment marks and line breaks in a text do not matter; mandatory words have to stand there
exactly and consecutively. Every template becomes states of one nondeterministic automaton over
words. It is run as a deterministic one whose states are made when first met and forgotten when there are too many, so its memory is bounded and
reading a text takes one step per word, whatever the number of templates. A start is possible at every word: a notice inside prose is found as well.

Null text has no words, so no places, empty label lists and score 0. Very long texts are read in pieces and the automaton goes on
over their edges. Repeated rows, null or repeated ids are rows like any other. An empty table gives no rows. Other
columns are kept; one named like the new column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.llm.terms import term_lists

# The phrases that always count, with their labels.
PHRASES = [
    ("mit", "MIT License"),
    ("apache", "Apache License"),
    ("gpl", "General Public License"),
]

# License notices, grants and conditions as published with these licenses.
TEMPLATES = [
    ("mit", "<<alt;match=Released|Licensed|Distributed|Available>> under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "<<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the <<beginOptional>>terms of the <<endOptional>>Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this <<var;match=1-3>> except in compliance with the License. You may obtain a copy of the License at "
                   "<<beginOptional>>http<<beginOptional>>s<<endOptional>>://<<endOptional>>www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2.0", "<<alt;match=under the terms of|licensed under>> the GNU General Public License <<beginOptional>>as published by the Free Software Foundation"
                "<<endOptional>><<beginOptional>>; either <<endOptional>>version 2"),
    ("gpl-3.0", "<<alt;match=under the terms of|licensed under>> the GNU General Public License <<beginOptional>>as published by the Free Software Foundation"
                "<<endOptional>><<beginOptional>>; either <<endOptional>>version 3"),
    ("lgpl", "GNU <<alt;match=Lesser|Library>> General Public License"),
    ("agpl-3.0", "GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>"
                 "<<beginOptional>>, either <<endOptional>>version 3"),
    ("cc-by-nc-4.0", "Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>"
                     "<<alt;match=CC BY-NC|Creative Commons Attribution-NonCommercial>> 4.0"),
    ("cc-by-4.0", "Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<alt;match=CC BY|Creative Commons Attribution>> 4.0"),
    ("cc-by-sa-4.0", "Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>"
                     "<<alt;match=CC BY-SA|Creative Commons Attribution-ShareAlike>> 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "<<var;match=0-2>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "Neither the name of <<var;match=1-20>> nor the names of <<beginOptional>>its <<endOptional>><<beginOptional>>the <<endOptional>>contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "<<beginOptional>>Creative Commons <<endOptional>>CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
]

FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_MARK = re.compile(r"<<(.*?)>>")


@dataclass(frozen=True)
class Words:
    """Mandatory wording."""

    words: tuple[str, ...]


@dataclass(frozen=True)
class Gap:
    """Any ``least`` to ``most`` words."""

    least: int
    most: int


@dataclass(frozen=True)
class Choice:
    """One of several runs of parts; an optional region is a choice with an empty run."""

    runs: tuple[tuple[object, ...], ...]


def _words(text: str) -> tuple[str, ...]:
    return tuple(w.decode() for found in term_lists(text.encode()) for w in found)


def parse(template: str) -> tuple[object, ...]:
    """The parts of a template."""
    stack: list[list[object]] = [[]]
    for at, piece in enumerate(_MARK.split(template)):
        kind, _, rule = piece.partition(";match=")
        if at % 2 == 0:
            if words := _words(piece):
                stack[-1].append(Words(words))
        elif kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional" and len(stack) > 1:
            region = tuple(stack.pop())
            stack[-1].append(Choice(((), region)))
        elif kind == "var" and re.fullmatch(r"\d+-\d+", rule):
            stack[-1].append(Gap(*map(int, rule.split("-"))))
        elif kind == "alt" and rule:
            stack[-1].append(Choice(tuple((Words(_words(x)),) for x in rule.split("|"))))
        else:
            raise ValueError(f"template markup <<{piece}>> is not known or not open")
    if len(stack) > 1:
        raise ValueError("an optional region is not closed")
    return tuple(stack[0])


class Automaton:
    """All templates in one automaton over words; accepting states carry the template's number."""

    MOST_STATES = 4096

    def __init__(self, templates: Sequence[str]):
        # Per state: steps by word, steps by any word, free steps, template accepted.
        self.by_word: list[dict[str, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.accepts: list[int | None] = []
        start = self._state()
        for number, template in enumerate(templates):
            head = self._state()
            self.free[start].append(head)
            end = self._build(parse(template), head)
            if end in self._closure({head}):
                raise ValueError(f"template {number} accepts no words at all")
            self.accepts[end] = number
        known = sorted({w for steps in self.by_word for w in steps})
        self.classes = {w.encode(): k + 1 for k, w in enumerate(known)}
        self.known = [None, *known]
        self.start = frozenset(self._closure({start}))
        # Whether a word of no template can lead away from the start.
        self.restless = any(self.by_any[s] for s in self.start)
        self._forget()

    def _state(self) -> int:
        for column, empty in ((self.by_word, {}), (self.by_any, []), (self.free, []), (self.accepts, None)):
            column.append(empty)
        return len(self.free) - 1

    def _build(self, parts: Sequence[object], at: int) -> int:
        for part in parts:
            if isinstance(part, Words):
                for w in part.words:
                    after = self._state()
                    self.by_word[at].setdefault(w, []).append(after)
                    at = after
            elif isinstance(part, Gap):
                end = self._state()
                for k in range(part.most + 1):
                    if k >= part.least:
                        self.free[at].append(end)
                    if k < part.most:
                        after = self._state()
                        self.by_any[at].append(after)
                        at = after
                at = end
            else:
                end = self._state()
                for run in part.runs:
                    head = self._state()
                    self.free[at].append(head)
                    self.free[self._build(run, head)].append(end)
                at = end
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def _forget(self) -> None:
        """Only the start is known: (set of states, steps by word class, templates accepted there)."""
        self.number = {self.start: 0}
        self.sets = [self.start]
        self.steps: list[dict[int, int]] = [{}]
        self.accepted: list[tuple[int, ...]] = [()]

    def _step(self, state: int, word: int) -> int:
        after: set[int] = set()
        for s in self.sets[state]:
            after.update(self.by_any[s])
            if word:
                after.update(self.by_word[s].get(self.known[word], ()))
        after = self._closure(after)
        found = tuple(sorted(self.accepts[s] for s in after if self.accepts[s] is not None))
        target = frozenset(after) | self.start  # a match may start at every word
        if target not in self.number:
            if len(self.sets) >= self.MOST_STATES:
                self._forget()
                state = -1
            self.number.setdefault(target, len(self.sets))
            if self.number[target] == len(self.sets):
                self.sets.append(target)
                self.steps.append({})
                self.accepted.append(found)
        if state >= 0:
            self.steps[state][word] = self.number[target]
        return self.number[target]

    def run(self, lists: Iterator[list[bytes]]) -> tuple[int, dict[int, list[int]]]:
        """Words read, and per template met: number of matches, least and greatest index of a match's last word."""
        found: dict[int, list[int]] = {}
        state = n = 0
        classify = self.classes.get
        for terms in lists:
            for at, term in enumerate(terms, n):
                word = classify(term, 0)
                if word or state or self.restless:
                    after = self.steps[state].get(word)
                    state = self._step(state, word) if after is None else after
                    for t in self.accepted[state]:
                        held = found.setdefault(t, [0, at, at])
                        held[0] += 1
                        held[2] = at
            n += len(terms)
        return n, found


class Scanner:
    """Phrases and templates with their labels."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.labels = [label for label, _ in (*phrases, *templates)]
        self.lengths = [len(_words(p)) for _, p in phrases]
        self.automaton = Automaton([t for _, t in (*phrases, *templates)])

    def scan(self, raw: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        n, found = self.automaton.run(term_lists(raw))
        base = {t: own for t, own in found.items() if t < len(self.lengths)}
        score = 1.0 if len(found) > len(base) else 0.5 if base else 0.0
        return (n, sum(own[0] for own in base.values()),
                min((own[1] - self.lengths[t] + 1 for t, own in base.items()), default=None),
                max((own[2] - self.lengths[t] + 1 for t, own in base.items()), default=None),
                self._joined(base), self._joined(found), score)

    def _joined(self, templates) -> str:
        return ",".join(sorted({self.labels[t] for t in templates}))


def with_licenses(df: DataFrame, text: str = "text", name: str = "licenses", phrases: Sequence[tuple[str, str]] = PHRASES,
                  templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Add the struct ``name``: n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a template accepts a part of the text, a half where only a phrase stands, else 0.
    """
    Scanner(phrases, templates)  # faults in the markup show here and not in a task
    kept = [c for c in df.columns if c != name]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_scanned")).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(phrases, templates)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [f.split()[0] for f in FIELDS.split(",")]
        for batch in batches:
            if batch.num_rows:
                *rest, raw = batch.column(0).flatten()
                found = [scanner.scan(r.as_py()) for r in raw.cast(pa.large_binary())]
                columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(rest, kept), pa.StructArray.from_arrays(columns, names)],
                                                 names=["row", "found"])

    schema = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.from_json(F.lit("{}"), FIELDS).alias("found")).schema
    done = packed.mapInArrow(run, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("found").alias(name))
