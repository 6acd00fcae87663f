"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are ratios of characters and words, and those of the lines before and
after it; a transition weight ties neighbouring lines. Exact forward-backward sums give each line's
marginal, and a document is as good as its lines, weighted by their length. A logistic curve over that mean,
fitted on the same sample, makes the score a probability.

The field is trained by its likelihood gradient on a bounded sample of labelled documents whose lines
take the document's label. Scoring reads every line of every text. Null text is one empty line. Labels,
language, source and ids are not features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evenfold.llm.spans import SpanHash, pieces, utf8, words

SAMPLE_ROWS = 5_000


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_KINDS = [_table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"#*$%&<>"), _table(b"!"), _table(b"|"), _table(b"0123456789"),
          _table(b".,;:?"), _table(bytes(range(128, 256)))]
FEATURES = 17


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and length of every line, and n + 1 offsets of the rows' lines. Lines end at \\n."""
    feeds = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate((offs[:-1], feeds + 1)), kind="stable")
    row = np.searchsorted(offs, np.sort(np.concatenate((offs[:-1], feeds))), side="right") - 1
    # Empty rows share an offset with the next row: order lines by row instead.
    line_row = np.concatenate((np.arange(len(offs) - 1), np.searchsorted(offs[1:], feeds, side="right")))
    line_start = np.concatenate((offs[:-1], feeds + 1))
    order = np.lexsort((line_start, line_row))
    row, starts = line_row[order], line_start[order]
    last = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)
    ends = np.where(last, offs[1:][row], np.concatenate((starts[1:] - 1, [0]))) if len(row) else starts
    size = (ends - starts).astype(np.float64)

    def count(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
        return (upto[ends] - upto[starts]).astype(np.float64)

    upper, lower, symbol, shout, pipe, digit, stop, wide = (count(k[buf]) for k in _KINDS)
    w_start, w_end, _ = words(buf, offs)
    h = SpanHash(buf, seed=3)(w_start, w_end)
    upto = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    n = (upto[1] - upto[0]).astype(np.float64)
    again = np.zeros(len(h) + 1, dtype=np.int32)
    again[1:][1:] = h[1:] == h[:-1]
    again = np.cumsum(again)
    repeat = (again[upto[1]] - again[np.minimum(upto[0] + 1, upto[1])]).astype(np.float64)
    line_hash = SpanHash(buf, seed=5)(starts, ends)
    by = np.lexsort((np.arange(len(row)), line_hash, row))
    twin = np.zeros(len(row))
    twin[by[1:]] = (line_hash[by][1:] == line_hash[by][:-1]) & (row[by][1:] == row[by][:-1])
    per, chars = np.maximum(n, 1), np.maximum(size, 1)
    caps = upper / np.maximum(upper + lower, 1)
    x = np.stack([
        np.ones(len(row)), caps, (caps > 0.6) & (n > 1), np.minimum(symbol / per, 2), symbol / per > 0.3, np.minimum(shout / per, 2), shout / per > 0.3,
        np.minimum(pipe / per, 1), pipe / per > 0.2, repeat / per, (repeat / per > 0.3) & (n > 2), digit / chars, np.minimum(stop / per, 2),
        np.minimum((size - n) / per / 10, 3), np.log1p(n) / 5, twin, n == 0,
    ], axis=1).astype(np.float64)
    return x, np.maximum(size, 1), np.searchsorted(row, np.arange(len(offs)))


def with_neighbours(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it in its document."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    heads, tails = rows[:-1][rows[:-1] < rows[1:]], rows[1:][rows[:-1] < rows[1:]] - 1
    before[heads], after[tails] = 0, 0
    return np.concatenate((x, before, after), axis=1)


def marginals(emit: np.ndarray, rows: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and expected transitions (2 x 2) over all rows.

    ``emit``: log weight of good against bad. Rows of like length run side by side.
    """
    good, pairs = np.zeros(len(emit)), np.zeros((2, 2))
    length = np.diff(rows)
    weight = np.exp(trans)
    for bits in range(int(length.max(initial=0)).bit_length()):
        own = np.flatnonzero((length >= 1 << bits) & (length < 2 << bits))
        if not len(own):
            continue
        steps = int(length[own].max())
        live = np.arange(steps)[:, None] < length[own][None, :]
        at = np.where(live, rows[own][None, :] + np.arange(steps)[:, None], 0)
        e = np.clip(np.where(live, emit[at], 0.0), -30, 30)
        score = np.stack((np.exp(-e / 2), np.exp(e / 2)), axis=2)  # bad, good
        alpha, beta = np.empty_like(score), np.empty_like(score)
        alpha[0] = score[0] / score[0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            a = (alpha[t - 1] @ weight) * score[t]
            alpha[t] = np.where(live[t][:, None], a / a.sum(axis=1, keepdims=True), alpha[t - 1])
        beta[-1] = 1.0
        for t in range(steps - 2, -1, -1):
            b = (beta[t + 1] * score[t + 1]) @ weight.T
            beta[t] = np.where(live[t + 1][:, None], b / b.sum(axis=1, keepdims=True), 1.0)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        good[at[live]] = p[live][:, 1]
        if steps > 1:
            joint = alpha[:-1, :, :, None] * weight[None, None] * (score[1:] * beta[1:])[:, :, None, :]
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            pairs += joint[live[1:]].sum(axis=0)
    return good, pairs


@dataclass(frozen=True)
class Field:
    """Trained weights: of the features, of the transitions, of the curve over the mean."""

    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def means(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Length-weighted share of good lines of every row."""
        x, size, rows = line_features(buf, offs)
        good, _ = marginals(with_neighbours(x, rows) @ self.weights, rows, self.trans)
        return np.add.reduceat(good * size, rows[:-1]) / np.add.reduceat(size, rows[:-1]) if len(rows) > 1 else np.zeros(0)

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.means(buf, offs)) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _adam(grad, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Ascend ``grad`` from ``start``."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and shift of P(y) over the columns of x."""
    x = np.concatenate((x.reshape(len(y), -1), np.ones((len(y), 1))), axis=1)

    def grad(w):
        return x.T @ (y - 1 / (1 + np.exp(-(x @ w)))) / len(y) - 1e-4 * w

    return tuple(_adam(grad, np.zeros(x.shape[1]), 800, 0.05).tolist())


def train(examples: list[tuple[str, int]], steps: int = 150) -> Field:
    """Fit on (text, 1 good / 0 bad). Without both labels the score is the same for all texts."""
    y = np.array([label for _, label in examples], dtype=np.float64)
    start = Field(np.zeros(3 * FEATURES), np.zeros((2, 2)))
    if not len(y) or y.min() == y.max():
        return Field(start.weights, start.trans, 0.0, 2.0 if len(y) and y.min() else 0.0)
    buf, offs = utf8(pa.array([t for t, _ in examples], pa.string()))
    parts = [line_features(buf[offs[s]:offs[e]], offs[s:e + 1] - offs[s]) for s, e in pieces(offs)]
    raw = np.concatenate([p[0] for p in parts])
    rows = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
    x = with_neighbours(raw, rows)
    line_y = np.repeat(y, np.diff(rows))
    each = np.repeat(1.0 / np.diff(rows), np.diff(rows))  # a document counts once
    n = len(y)
    seen = np.zeros((2, 2))
    for label, size in zip(y.astype(int), np.diff(rows)):
        seen[label, label] += size - 1
    k = x.shape[1]

    def grad(w):
        good, pairs = marginals(x @ w[:k], rows, w[k:].reshape(2, 2))
        unary = x.T @ ((line_y - good) * each) / n - 1e-4 * w[:k]
        return np.concatenate((unary, ((seen - pairs) / max(1.0, seen.sum())).ravel() - 1e-2 * w[k:]))

    w = _adam(grad, np.zeros(k + 4), steps, 0.1)
    field = Field(w[:k], w[k:].reshape(2, 2))
    means = np.concatenate([field.means(buf[offs[s]:offs[e]], offs[s:e + 1] - offs[s]) for s, e in pieces(offs)])
    slope, shift = logistic(_logit(means), y)
    return Field(field.weights, field.trans, slope, shift)


def with_score(df: DataFrame, field: Field, text: str = "text", name: str = "score") -> DataFrame:
    """Add or replace ``name``: the probability that the whole text is good."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            for a, b in pieces(offs):
                part = batch.slice(a, b - a)
                found = field.scores(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(f.name)) for f in kept], pa.array(found)], names=schema.names)

    return df.mapInArrow(run, schema)
