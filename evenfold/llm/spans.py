"""Text of Arrow batches as bytes in numpy: words, hashes of any span, bounded pieces.

Strings are read in place from the Arrow buffers. A span is hashed from prefix sums over pairs of neighbouring
bytes times ``base ** position``, modulo 2**64, so the hash of any span costs a few look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WHITE = np.array([9, 10, 11, 12, 13, 32])
PIECE = 1 << 20


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=32)
def _byte_table(seed: int, lower: bool) -> np.ndarray:
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


#: Fixed value: the odd base of all prefix sums.
BASE = 0x9E6C63D0876A9A35
_POWERS: list[np.ndarray] = []
#: Powers that outlive their buffer; an idle worker would hold more for nothing.
KEPT_POWERS = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; a worker keeps one pair of arrays, of KEPT_POWERS at most."""
    if _POWERS and n <= len(_POWERS[0]):
        return _POWERS[0], _POWERS[1]
    made = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(max(n, KEPT_POWERS), b, dtype=np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps, out=steps))
    if n <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


class SpanHash:
    """Hashes of spans of one buffer.

    The summand of a position is the product of two table entries, of its byte and of the next one. Were it a function of one
    byte alone, two letters in the pattern of bit parity and the same letters swapped would meet for every
    base and every table, because that pattern's sum is divisible by each power of two from some length on. The last byte
    of a span, whose successor is outside, is added by itself.
    """

    def __init__(self, buf: np.ndarray, seed: int = 1, lower: bool = False):
        self.powers, self.inverse = _powers(len(buf) + 1)
        table = _byte_table(seed, lower)
        self.last = table[buf]
        self.prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
        if len(buf):
            pairs = _byte_table(seed + 1_000_003, lower)[buf]
            pairs[:-1] *= self.last[1:]
            pairs *= self.powers[:len(buf)]
            np.cumsum(pairs, out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """The hashes of all spans of k bytes, one at least, without a look-up for each."""
        n = max(0, len(self.last) - k + 1)
        out = self.prefix[k - 1:k - 1 + n] - self.prefix[:n]
        out *= self.inverse[:n]
        out += self.last[k - 1:] * self.powers[k - 1]
        out += np.uint64(k)
        return mix(out)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal spans of equal length; not spread."""
        if not len(self.last):
            return np.zeros(len(starts), dtype=np.uint64)
        final = np.maximum(ends - 1, starts)
        out = (self.prefix[final] - self.prefix[starts]) * self.inverse[starts]
        at = np.minimum(final, len(self.last) - 1)
        return out + np.where(ends > starts, self.last[at] * self.powers[final - starts], np.uint64(0))


_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[WHITE] = False


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and n + 1 offsets of the rows' words."""
    inside = _IS_WORD[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    begin[heads] = inside[heads]
    end[tails] = inside[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)
