"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

The kernel counts the three-letter subsequences that two strings share, each occurrence weighted by
DECAY to the power of its span, up to SPAN characters; strings are scaled to unit length. Letters put between thus
lower a match but do not break it. Strings are single words without signs, with marks for begin and end, and runs of
single letters ("i d i o t") as one string; long words are read in overlapping windows, so no part of a text is skipped.

Landmarks are training words: those most tied to the label, and common others. The Nystroem map sends a string
to its kernel values with the landmarks times the inverse root of the landmarks' own kernel matrix, where a linear
machine with squared hinge loss is trained. Only texts are labelled, so training alternates: each toxic text
is represented by its worst word, and the worst words of clean texts are added as counterexamples.
A text scores by its worst word and by a soft count of bad ones; a logistic curve fitted on the sample
makes that a probability.

As the kernel is a product over subsequences, the trained function is one weight per subsequence, which
is what the scoring tasks receive (a table of fixed size). Null or empty text has no word and gets the
curve's lowest value. Labels, language, source and ids are not inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evenfold.llm.line_crf import logistic
from evenfold.llm.spans import SpanHash, pieces, utf8, words

SAMPLE_ROWS = 6_000
LANDMARKS = 192
DECAY, SPAN, WIDEST = 0.85, 6, 40
BEGIN, END = 62, 63
#: Three symbols of six bits.
CODES = 1 << 18
NO_WORD = -3.0
#: One string's weight in training stops here, which keeps the descent well conditioned.
MOST_WEIGHT = 30.0
SHARPNESS = 4.0
ALONE = 0.25


def _alphabet() -> np.ndarray:
    """64 symbols: letters without case, digits, other signs, and classes of the bytes beyond ASCII."""
    table = np.full(256, 28, dtype=np.int32)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[48:58] = 27
    table[128:] = 29 + np.arange(128) % 32
    return table


ALPHABET = _alphabet()
_EDGE = ALPHABET == 28


@lru_cache(maxsize=None)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    i, j, k = (np.array([t[c] for t in found], dtype=np.int64) for c in range(3))
    return i, j, k, DECAY ** (k - i + 1).astype(np.float64)


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits alone, and start, end and row of every string to score: words, spelled-out runs, windows."""
    starts, ends, rows = words(buf, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    solid = ~_EDGE[buf]
    upto = np.concatenate(([0], np.cumsum(solid)))
    a, b = upto[starts], upto[ends]
    own = b > a
    a, b, row, letters = a[own], b[own], row[own], buf[solid]
    if not len(a):
        return letters, a, b, row
    single = (b - a == 1).astype(np.int8)
    edge = np.concatenate(([0], single, [0]))
    edge_row = np.concatenate(([-1], row, [-1]))
    run = np.flatnonzero((edge[1:-1] == 1) & ((edge[:-2] == 0) | (edge_row[:-2] != row)))
    stop = np.flatnonzero((edge[1:-1] == 1) & ((edge[2:] == 0) | (edge_row[2:] != row)))
    long = stop - run >= 2
    a, b, row = (np.concatenate(p) for p in ((a, a[run[long]]), (b, b[stop[long]]), (row, row[run[long]])))
    wide = np.flatnonzero(b - a > WIDEST)
    if len(wide):
        step = WIDEST // 2
        more = -(-(b[wide] - a[wide] - WIDEST) // step) + 1
        inside = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        s = np.repeat(a[wide], more) + inside * step
        keep = np.ones(len(a), dtype=bool)
        keep[wide] = False
        a, b, row = (np.concatenate(p) for p in (
            (a[keep], s), (b[keep], np.minimum(s + WIDEST, np.repeat(b[wide], more))), (row[keep], np.repeat(row[wide], more))))
    return letters, a, b, row


def subsequences(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Batches of (strings, codes, weights): the weighted subsequences of strings of one length, of unit length."""
    size = ends - starts
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        i, j, k, w = _triples(int(n) + 2)
        for s in range(0, len(own), 4000):
            part = own[s:s + 4000]
            text = np.empty((len(part), int(n) + 2), dtype=np.int32)
            text[:, 0], text[:, -1] = BEGIN, END
            text[:, 1:-1] = ALPHABET[buf[starts[part][:, None] + np.arange(n)]]
            code = (text[:, i] << 12) | (text[:, j] << 6) | text[:, k]
            # Equal subsequences of a string add up before they are squared.
            order = np.argsort(code, axis=1)
            sorted_ = np.take_along_axis(code, order, axis=1)
            upto = np.cumsum(w[order], axis=1)
            last = np.ones_like(sorted_, dtype=bool)
            last[:, :-1] = sorted_[:, 1:] != sorted_[:, :-1]
            norm = np.empty(len(part))
            flat_row, flat_col = np.nonzero(last)
            total = upto[flat_row, flat_col]
            total[1:] -= np.where(flat_row[1:] == flat_row[:-1], total[:-1], 0)
            norm = np.sqrt(np.bincount(flat_row, total * total, minlength=len(part)))
            yield part, code, w[None, :] / np.maximum(norm, 1e-12)[:, None]


@dataclass(frozen=True)
class Machine:
    """One weight per subsequence, a bias, and the curve over a text's worst word and soft count."""

    table: np.ndarray
    bias: float
    curve: tuple[float, float, float]

    def strings(self, buf, starts, ends) -> np.ndarray:
        out = np.empty(len(starts))
        for part, code, weight in subsequences(buf, starts, ends):
            out[part] = (self.table[code] * weight).sum(axis=1) + self.bias
        return out

    def summary(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Per row the highest value of any string and the soft maximum over all of them."""
        buf, a, b, row = units(buf, offs)
        if not len(a):
            return np.full((len(offs) - 1, 2), NO_WORD)
        _, one, which = np.unique(SpanHash(buf, seed=23, lower=True)(a, b), return_index=True, return_inverse=True)
        return summed(self.strings(buf, a[one], b[one])[which], row, len(offs) - 1)

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.summary(buf, offs) @ np.array(self.curve[:2]) + self.curve[2])))


def summed(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    top = np.full(rows, NO_WORD)
    np.maximum.at(top, row, np.maximum(value, NO_WORD))
    soft = np.bincount(row, np.exp(SHARPNESS * (value - top[row])), rows)
    return np.stack((top, top + np.log(np.maximum(soft, 1e-9)) / SHARPNESS * (soft > 0)), axis=1)


@dataclass(frozen=True)
class Landmarks:
    """Subsequence weights of the landmarks, as columns of the codes that occur in any of them."""

    codes: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, buf, starts, ends) -> Landmarks:
        found = [(part, code, weight) for part, code, weight in subsequences(buf, starts, ends)]
        codes = np.unique(np.concatenate([code.ravel() for _, code, _ in found]))
        dense = np.zeros((len(starts), len(codes)))
        for part, code, weight in found:
            np.add.at(dense, (part[:, None], np.searchsorted(codes, code)), weight)
        return cls(codes, dense)

    def kernel(self, buf, starts, ends) -> np.ndarray:
        """Kernel values of strings with the landmarks."""
        place = np.full(CODES, len(self.codes), dtype=np.int32)
        place[self.codes] = np.arange(len(self.codes))
        columns = np.vstack((self.weights.T, np.zeros((1, len(self.weights))))).astype(np.float32)
        out = np.zeros((len(starts), len(self.weights)))
        for part, code, weight in subsequences(buf, starts, ends):
            for s in range(0, len(part), 250):
                out[part[s:s + 250]] = np.einsum("wt,wtm->wm", weight[s:s + 250].astype(np.float32), columns[place[code[s:s + 250]]])
        return out

    def spread(self, function: np.ndarray) -> np.ndarray:
        """One weight per subsequence from one per landmark."""
        table = np.zeros(CODES)
        table[self.codes] = function @ self.weights
        return table


def _hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 500) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated descent; the last weight is the bias."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    ridge = 1e-3
    rate = 1 / (2 * np.linalg.norm(x * np.sqrt(cost)[:, None], 2) ** 2 + ridge)
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        miss = np.maximum(0, 1 - y * (x @ v))
        step = v - rate * (-2 * x.T @ (cost * y * miss) + ridge * v)
        v, w = step + t / (t + 3) * (step - w), step
    return w


def _strings(whole: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct strings of a sample, piece by piece: one buffer, starts, ends, and (row, string) pairs."""
    names, texts, rows, pairs = [], [], [], []
    for s, e in pieces(offs):
        buf, a, b, row = units(whole[offs[s]:offs[e]], offs[s:e + 1] - offs[s])
        if not len(a):
            continue
        h = SpanHash(buf, seed=23, lower=True)(a, b)
        own, one = np.unique(h, return_index=True)
        raw = buf.tobytes()
        names.append(own)
        texts += [raw[i:j] for i, j in zip(a[one].tolist(), b[one].tolist())]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
        pairs.append(h[first])
        rows.append(row[first] + s)
    if not names:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, none, none
    own, one = np.unique(np.concatenate(names), return_index=True)
    chosen = [texts[i] for i in one.tolist()]
    size = np.fromiter(map(len, chosen), np.int64, len(chosen))
    end = np.cumsum(size)
    return np.frombuffer(b"".join(chosen), np.uint8), end - size, end, np.concatenate(rows), np.searchsorted(own, np.concatenate(pairs))


def train(examples: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = 3) -> Machine:
    """Fit on (text, 1 toxic / 0 clean). Without both labels every text scores as the only label seen."""
    y = np.array([label for _, label in examples])
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(CODES), 0.0, (0.0, 0.0, 4.0 if len(y) and y.min() else -4.0))
    whole, offs = utf8(pa.array([t for t, _ in examples], pa.string()))
    buf, a, b, row, which = _strings(whole, offs)
    toxic, clean = y.sum(), len(y) - y.sum()
    pos = np.bincount(which, y[row], len(a)) / toxic
    neg = np.bincount(which, 1 - y[row], len(a)) / clean
    tie = np.where(pos * toxic >= 3, (pos - neg) * np.log((pos + 0.5 / toxic) / (neg + 0.5 / clean)), 0)
    tie = np.where(pos > neg, tie, 0)
    strong = np.argsort(-tie, kind="stable")[:landmarks * 2 // 3]
    strong = strong[tie[strong] > 0]
    common = np.argsort(-neg, kind="stable")[:landmarks - len(strong)]
    chosen = np.concatenate((strong, common[~np.isin(common, strong)]))
    marks = Landmarks.of(buf, a[chosen], b[chosen])
    own = marks.kernel(buf, a[chosen], b[chosen])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def worst_of(value: np.ndarray, rows_wanted: np.ndarray) -> np.ndarray:
        """The string of highest value of each wanted row."""
        own = rows_wanted[row]
        r, u = row[own], which[own]
        order = np.lexsort((-value[u], r))
        first = np.flatnonzero(np.concatenate(([True], r[order][1:] != r[order][:-1])))
        return u[order[first]]

    # A string counts for the label as often as it is a toxic text's worst, against it as often as clean texts hold it.
    value, bad = tie, y == 1
    in_clean = np.rint(neg * clean).astype(np.int64)
    against = np.random.default_rng(0).permutation(np.flatnonzero(in_clean))[:4_000]
    machine = None
    for at in range(rounds):
        witness, times = np.unique(worst_of(value, bad), return_counts=True)
        # Texts without a likely string teach nothing; the choice of a single text may be a chance word of it and counts less.
        fit = value[witness] > (0 if at == 0 else -0.5)
        witness, times = witness[fit], np.where(times[fit] > 1, times[fit], ALONE)
        if not len(witness):
            break
        against = np.unique(np.concatenate((against, worst_of(value, ~bad), witness[in_clean[witness] > 0])))
        mine = np.concatenate((witness, against))
        x = marks.kernel(buf, a[mine], b[mine]) @ root
        sign = np.concatenate((np.ones(len(witness)), -np.ones(len(against))))
        weight = np.concatenate((times * clean / toxic, in_clean[against]))
        w = _hinge(x, sign, np.minimum(weight, MOST_WEIGHT))
        machine = Machine(marks.spread(root @ w[:-1]), float(w[-1]), (0.0, 0.0, 0.0))
        value = machine.strings(buf, a, b)
    if machine is None:
        return Machine(np.zeros(CODES), 0.0, (0.0, 0.0, float(np.log(toxic / clean))))
    summary = [machine.summary(whole[offs[s]:offs[e]], offs[s:e + 1] - offs[s]) for s, e in pieces(offs)]
    curve = logistic(np.concatenate(summary), y.astype(np.float64))
    return Machine(machine.table.astype(np.float32), machine.bias, curve)


def with_score(df: DataFrame, shared: Broadcast, text: str = "text", name: str = "score") -> DataFrame:
    """Add or replace ``name``: the probability that the whole text is toxic."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            for a, b in pieces(offs):
                part = batch.slice(a, b - a)
                found = shared.value.scores(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(f.name)) for f in kept], pa.array(found)], names=schema.names)

    return df.mapInArrow(run, schema)
