"""Repeated passages by a sorted array of sampled suffixes, compared through prefix hashes.

Every string of ``length`` bytes that occurs twice is found, and each byte it covers is removed.

* Sampling. Of the half-length grams in a window of ``length`` bytes the one with the least hash is
  its anchor. Equal windows have equal anchors at equal offsets, so only suffixes that begin at anchors
  need sorting, about one in a hundred, and only anchors whose gram occurs again.
* Sorting. Anchors with one gram form a group. Prefix sums of a polynomial hash give the hash of any
  span, and binary search over them the longest common extension of two suffixes in a logarithm of its
  length; a mergesort whose comparisons use it sorts the group by what follows the anchor
  and, a second time, by what precedes it. All comparisons of a merge level run as one array step.
* Evidence. Neighbours in either order that extend over ``length`` bytes or more prove their bytes
  repeated, after their bytes are compared. The longest extension to each side bounds what could be
  repeated at all; where the neighbours leave a gap below that bound, the group is compared
  directly, so the result is exact.

Groups of more than ``group_limit`` occurrences never meet in one task. They are cut anywhere into chunks, each of which proves
what it can by the same sort. Windows that a chunk cannot prove, and one of each kind that it has proven, are then
matched across chunks by a shuffle on their hash, which spreads any group.

Runs of words are found by the same steps: each word stands as the 8 bytes of its hash, so ``n`` words are a string of 8 * n
bytes, equal whatever white space stands between the words. Positions count those bytes and are mapped back at the end.

Equal texts are one text: if it has ``length`` bytes and two rows, all of it is repeated. Null text is
empty, nulls in other columns pass through. Texts are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.llm.spans import SpanHash, mix, pieces, utf8, words
from evenfold.llm.tables import Workspace

GROUP_LIMIT = 4_000
CHUNK_BYTES = 1_500_000
SEGMENT = 1 << 22
SLICE = 1024
#: Bytes of whole rows taken at once; anchors need some hundred bytes of memory for each.
TAKEN = 1 << 19
_POS = np.uint64((1 << 24) - 1)


def text_name(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit name of every whole row."""
    return (SpanHash(buf, seed=5)(offs[:-1], offs[1:]) ^ mix(SpanHash(buf, seed=13).raw(offs[:-1], offs[1:]))).view(np.int64)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n - w + 1], upto[w - 1:n])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of rows of one buffer: position, first and last window start, gram hash."""
    k, n = length // 2, len(buf)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty
    gram = SpanHash(buf, seed=5).windows(k)
    least = _sliding_min((gram & ~_POS) | np.arange(len(gram), dtype=np.uint64), length - k + 1)
    crossing = np.zeros(n + 2, dtype=np.int32)
    inner = offs[1:-1]
    np.add.at(crossing, np.maximum(inner - length + 1, 0), 1)
    np.add.at(crossing, inner, -1)
    x = np.flatnonzero(np.cumsum(crossing[:n - length + 1]) == 0)
    where = (least[x] & _POS).astype(np.int64)
    if not len(x):
        return empty, empty, empty, empty
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    last = np.append(first[1:], len(x)) - 1
    p = where[first]
    return p, x[first], x[last], gram[p].view(np.int64)


def _row_anchors(buf: np.ndarray, offs: np.ndarray, length: int, segment: int = SEGMENT) -> Iterator[tuple]:
    """Anchors of a piece; a very long row is walked in overlapping segments of bounded size, which changes no anchor."""
    if len(buf) <= 2 * segment:
        yield anchors(buf, offs, length)
        return
    for start, stop in zip(offs[:-1].tolist(), offs[1:].tolist()):
        held = None
        for s in range(start, stop, segment):
            part = buf[s:min(s + segment + length - 1, stop)]
            p, a, b, g = anchors(part, np.array([0, len(part)]), length)
            if not len(p):
                continue
            p, a, b = p + s, a + s, b + s
            if held is not None:
                if held[0][0] == p[0]:  # its windows go on over the edge
                    a[0] = held[1][0]
                else:
                    yield held
            yield p[:-1], a[:-1], b[:-1], g[:-1]
            held = p[-1:], a[-1:], b[-1:], g[-1:]
        if held is not None:
            yield held


def _batches(batch: pa.RecordBatch, column: int = 0):
    buf, offs = utf8(batch.column(column))
    for a, b in pieces(offs, TAKEN):
        yield a, b, buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]


#: Bytes that stand for a word, where words are compared.
WORD = 8


def _word_names(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose words are WORD bytes each and nothing else, and their offsets."""
    starts, ends, rows = words(buf, offs)
    return SpanHash(buf, seed=31)(starts, ends).view(np.uint8), rows * WORD


def _indexed(df: DataFrame, text: str, length: int, segment: int = SEGMENT, by_word: bool = False) -> DataFrame:
    """(key, tid, n): how often each anchor gram is in each text; a text once per task."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, buf, offs in _batches(batch):
                names = text_name(buf, offs)
                if by_word:
                    buf, offs = _word_names(buf, offs)
                rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for p, _, _, gram in _row_anchors(buf, offs, length, segment):
                    rows.append(np.searchsorted(offs, p, side="right") - 1)
                    keys.append(gram)
                fresh = np.zeros(len(names), dtype=bool)
                for i, t in enumerate(names.tolist()):
                    if t not in seen:
                        seen.add(t)
                        fresh[i] = True
                row, key = np.concatenate(rows), np.concatenate(keys)
                own = fresh[row]
                row, key = row[own], key[own]
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
                count = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(names[row[first]]), pa.array(count.astype(np.int64))], names=["key", "tid", "n"])

    return df.select(text).mapInArrow(run, "key long, tid long, n long")


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows of (key, ...) whose key has two rows or more, or n > 1; streamed in key order."""
    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table.num_rows < 2:
                held = table
                continue
            key = table.column(0).to_numpy()
            twice = table.column("n").to_numpy() > 1
            same = key[1:] == key[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            # The last row waits for the next batch; if it has a twin here it goes on as certain.
            done = table.slice(0, table.num_rows - 1).filter(pa.array(twice[:-1]))
            held = table.slice(table.num_rows - 1)
            if twice[-1]:
                held = held.set_column(held.schema.get_field_index("n"), "n", pa.array([max(2, held.column("n")[0].as_py())], pa.int64()))
            yield from done.to_batches()
        if held is not None and held.num_rows:
            yield from held.filter(pa.array(held.column("n").to_numpy() > 1)).to_batches()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, rows.schema)


def _packed(df: DataFrame, text: str) -> DataFrame:
    """(tid, z): one compressed text per name and task."""
    def run(batches):
        seen: set[int] = set()
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for _, _, buf, offs in _batches(batch):
                raw, names, packed = buf.tobytes(), [], []
                for t, a, b in zip(text_name(buf, offs).tolist(), offs[:-1].tolist(), offs[1:].tolist()):
                    if t not in seen:
                        seen.add(t)
                        names.append(t)
                        packed.append(press.compress(raw[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["tid", "z"])

    return df.select(text).mapInArrow(run, "tid long, z binary")


CONTEXT = "key long, tid long, least int, most int, left int, around binary, p array<long>"


def _context_name(buf: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Equal for equal contexts: bytes [first, last) of ``buf`` around an anchor of gram ``key``, ``left`` bytes in."""
    return SpanHash(buf, seed=19)(first, last) ^ mix(key.view(np.uint64)) ^ mix(left.astype(np.uint64))


def _contexts(texts: DataFrame, length: int, segment: int = SEGMENT, by_word: bool = False) -> DataFrame:
    """The bytes around every anchor of (tid, z, keys) whose gram is in ``keys``.

    Equal contexts of one walk over a text are one row with the list of their positions, so a run of one character is a
    few hundred rows. Rows leave in slices of SLICE rows, each of at most SLICE positions.
    """
    reach = length - length // 2

    def folded(raw: bytes, tid: int, p: np.ndarray, least: np.ndarray, most: np.ndarray, gram: np.ndarray):
        first, last = np.maximum(p - reach, 0), np.minimum(p + length, len(raw))
        left = p - first
        order, kind = np.arange(len(p)), np.arange(len(p))
        if len(np.unique(gram)) < len(p):
            at = int(first[0])
            near = np.frombuffer(raw, np.uint8, int(last[-1]) - at, at)
            _, kind = np.unique(_context_name(near, first - at, last - at, gram, left), return_inverse=True)
            order = np.argsort(kind, kind="stable")
            kind = kind[order]
        # A row begins with each kind and after SLICE positions of one.
        head = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        since = np.arange(len(p)) - np.repeat(head, np.diff(np.append(head, len(p))))
        row = np.append(np.flatnonzero(since % SLICE == 0), len(p))
        for r in range(0, len(row) - 1, SLICE):
            edge = row[r:r + SLICE + 1]
            one = order[edge[:-1]]
            around = [raw[a:b] for a, b in zip(first[one].tolist(), last[one].tolist())]
            places = pa.ListArray.from_arrays(pa.array((edge - edge[0]).astype(np.int32)), pa.array(p[order[edge[0]:edge[-1]]]))
            small = (c[one].astype(np.int32) for c in (least, most, left))
            yield pa.RecordBatch.from_arrays([pa.array(gram[one]), pa.array(np.full(len(one), tid, dtype=np.int64)), *map(pa.array, small),
                                              pa.array(around, pa.binary()), places], names=["key", "tid", "least", "most", "left", "around", "p"])

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for tid, z, keys in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = open_.decompress(z)
                buf, wanted = np.frombuffer(raw, dtype=np.uint8), np.array(keys, dtype=np.int64)
                if by_word:
                    buf, _ = _word_names(buf, np.array([0, len(buf)]))
                    raw = buf.tobytes()
                for p, x1, x2, gram in _row_anchors(buf, np.array([0, len(buf)]), length, segment):
                    own = np.isin(gram, wanted)
                    if own.any():
                        yield from folded(raw, tid, p[own], (p - x2)[own], (p - x1)[own], gram[own])

    return texts.select("tid", "z", "keys").mapInArrow(run, CONTEXT)


class Suffixes:
    """Anchored contexts in one buffer: ``at`` is the anchor, ``left`` and ``right`` the bytes around it."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray):
        self.buf, self.at, self.left, self.right, self.group = buf, at, left, right, group
        self.hash = SpanHash(buf, seed=17)

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension to the right, by binary search on prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        a, b = self.at[i], self.at[j]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hash.raw(a, a + mid) == self.hash.raw(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension to the left."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.left[i], self.left[j])
        a, b = self.at[i], self.at[j]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hash.raw(a - mid, a) == self.hash.raw(b - mid, b)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """i before j, by what follows and then what precedes the anchor, or the other way round."""
        sign = self._side(i, j, forward)
        tie = np.flatnonzero(sign == 0)
        if len(tie):
            sign[tie] = self._side(i[tie], j[tie], not forward)
        return np.where(sign == 0, i < j, sign < 0)

    def _side(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        if forward:
            n, size, step = self.after(i, j), self.right, 0
        else:
            n, size, step = self.before(i, j), self.left, -1
        inside = n < np.minimum(size[i], size[j])
        sign = np.sign(size[i] - size[j])
        way = n[inside] if forward else -n[inside]
        a, b = self.buf[self.at[i[inside]] + way + step], self.buf[self.at[j[inside]] + way + step]
        sign[inside] = np.sign(a.astype(np.int64) - b)
        return sign

    def sort(self, forward: bool) -> np.ndarray:
        """Mergesort of all groups at once: at each level every run is merged with its neighbour."""
        order = np.argsort(self.group, kind="stable")
        n = len(order)
        if not n:
            return order
        group = self.group[order]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        start = np.repeat(head, np.diff(np.append(head, n)))
        stop = np.repeat(np.append(head[1:], n), np.diff(np.append(head, n)))
        run = 1
        place = np.arange(n)
        while run < (stop - start).max():
            inside = place - start
            pair = start + inside // (2 * run) * (2 * run)
            middle, end = np.minimum(pair + run, stop), np.minimum(pair + 2 * run, stop)
            early = place < middle
            # Rank of each element in the other run of its pair.
            low = np.where(early, middle, pair)
            high = np.where(early, end, middle)
            floor = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                smaller = self.less(order[mid], order[open_], forward)
                low[open_] = np.where(smaller, mid + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], mid)
            moved = np.empty_like(order)
            moved[np.where(early, place, pair + place - middle) + low - floor] = order
            order = moved
            run *= 2
        return order

    def verified(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the bytes of the extensions are equal, as their hashes say."""
        ok = np.ones(len(i), dtype=bool)
        for s in range(0, len(i), 512):
            a, b, l, n = i[s:s + 512], j[s:s + 512], left[s:s + 512], (left + right)[s:s + 512]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differ = self.buf[np.repeat(self.at[a] - l, n) + inside] != self.buf[np.repeat(self.at[b] - l, n) + inside]
            ok[s + np.repeat(np.arange(len(a)), n)[differ]] = False
        return ok


def repeated_around(s: Suffixes, many: np.ndarray, least_off: np.ndarray, most_off: np.ndarray, length: int,
                    settle: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per context how far the repeated bytes reach left and right of its anchor (-1: nothing is repeated).

    ``many``: the context itself occurs twice. Offsets of windows the anchor stands for: least to most. The third result
    is the first and last proven offset; with ``settle`` what neighbours leave open is compared with the whole group.
    """
    n = len(s.at)
    reach_l, reach_r = np.full(n, -1), np.full(n, -1)
    whole = many & (s.left + s.right >= length)
    reach_l[whole], reach_r[whole] = s.left[whole], s.right[whole]
    bound_l, bound_r = np.where(many, s.left, 0), np.where(many, s.right, 0)
    gap = np.zeros((n, 2), dtype=np.int64)  # proven offsets as one range: first, last
    gap[:, 0], gap[:, 1] = np.where(whole, length - s.right, 1 << 40), np.where(whole, s.left, -1)
    for forward in (True, False):
        order = s.sort(forward)
        i, j = order[:-1], order[1:]
        same = s.group[i] == s.group[j]
        i, j = i[same], j[same]
        l, r = s.before(i, j), s.after(i, j)
        for a in (i, j):
            np.maximum.at(bound_l, a, l)
            np.maximum.at(bound_r, a, r)
        proof = l + r >= length
        i, j, l, r = i[proof], j[proof], l[proof], r[proof]
        fine = s.verified(i, j, l, r)
        for a in (i[fine], j[fine]):
            _prove(a, l[fine], r[fine], reach_l, reach_r, gap, length)
    # Windows an anchor stands for that are neither proven nor out of reach.
    low, high = np.maximum(length - bound_r, least_off), np.minimum(bound_l, most_off)
    unsure = np.flatnonzero((low <= high) & ((gap[:, 0] > low) | (gap[:, 1] < high)))
    if settle and len(unsure):
        _compare_all(s, unsure, low, high, reach_l, reach_r, length)
    return reach_l, reach_r, gap


def _prove(a, l, r, reach_l, reach_r, gap, length) -> None:
    np.maximum.at(reach_l, a, l)
    np.maximum.at(reach_r, a, r)
    np.minimum.at(gap[:, 0], a, length - r)
    np.maximum.at(gap[:, 1], a, l)


def _compare_all(s: Suffixes, unsure, low, high, reach_l, reach_r, length) -> None:
    """Windows of unsure contexts against those of their whole group, one offset after the other."""
    order = np.argsort(s.group, kind="stable")
    group = s.group[order]
    touched = np.unique(s.group[unsure])
    doubtful = np.zeros(len(s.at), dtype=bool)
    doubtful[unsure] = True
    first, last = np.searchsorted(group, touched, "left"), np.searchsorted(group, touched, "right")
    sizes = last - first
    member = order[np.repeat(first, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    for o in range(int(low[unsure].min()), int(high[unsure].max()) + 1):
        if not (doubtful & (low <= o) & (o <= high)).any():
            continue
        own = member[(s.left[member] >= o) & (s.right[member] >= length - o)]
        h = mix(s.hash.raw(s.at[own] - o, s.at[own] - o + length)) ^ s.group[own].astype(np.uint64)
        by = np.argsort(h, kind="stable")
        own, h = own[by], h[by]
        twin = np.flatnonzero(h[1:] == h[:-1])
        fine = s.verified(own[twin], own[twin + 1], np.full(len(twin), o), np.full(len(twin), length - o))
        for a in (own[twin[fine]], own[twin[fine] + 1]):
            np.maximum.at(reach_l, a, o)
            np.maximum.at(reach_r, a, length - o)


def _chunk_spans(table: pa.Table, length: int, settle: bool = True) -> Iterator[pa.RecordBatch]:
    """(tid, lo, hi) of repeated bytes around the anchors of whole groups.

    Without ``settle`` the groups may go on elsewhere: with them come rows (h, tid, lo) of the windows left
    open, and (h) alone of the kinds of windows proven here.
    """
    key, tid, least, most, left = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "tid", "least", "most", "left"))
    buf, offs = utf8(table.column("around"))
    name = np.concatenate([_context_name(buf[offs[a]:offs[b]], offs[a:b] - offs[a], offs[a + 1:b + 1] - offs[a], key[a:b], left[a:b])
                           for a, b in pieces(offs)])
    _, one, which = np.unique(name, return_index=True, return_inverse=True)
    # From here on, one entry per occurrence: its text, place and kind of context.
    places = pa.concat_arrays(table.column("p").chunks)
    times = pc.list_value_length(places).to_numpy()
    p, tid, which = places.flatten().to_numpy(), np.repeat(tid, times), np.repeat(which, times)
    order = np.lexsort((p, tid, which))
    fresh = np.ones(len(p), dtype=bool)
    fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in (p, tid, which)], axis=0)
    many = np.bincount(which[order][fresh], minlength=len(one)) > 1
    _, group = np.unique(key[one], return_inverse=True)
    raw = buf.tobytes()
    around = [raw[a:b] for a, b in zip(offs[one].tolist(), offs[one + 1].tolist())]
    size = np.fromiter(map(len, around), np.int64, len(around))
    start = np.cumsum(size) - size
    s = Suffixes(np.frombuffer(b"".join(around), np.uint8), start + left[one], left[one], size - left[one], group)
    least, most = least[one], most[one]
    reach_l, reach_r, gap = repeated_around(s, many, least, most, length, settle)
    row = np.flatnonzero(reach_l[which] >= 0)
    yield _rows(np.zeros(0, np.int64), *_joined(tid[row], p[row] - reach_l[which[row]], p[row] + reach_r[which[row]]))
    if settle:
        return
    other = SpanHash(s.buf, seed=23)

    def windows(c: np.ndarray, first: np.ndarray, last: np.ndarray):
        """Context and offset of every window, and its hash."""
        n = np.maximum(last - first + 1, 0)
        at = np.repeat(np.arange(len(c)), n)
        o = first[at] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = s.at[c[at]] - o
        return at, o, (s.hash(begin, begin + length) ^ mix(other.raw(begin, begin + length))).view(np.int64)

    every = np.arange(len(one))
    _, _, h = windows(every, np.maximum(least, gap[:, 0]), np.minimum(most, gap[:, 1]))
    h = np.unique(h)
    yield _rows(h, None, None, None)
    for first, last in ((least, np.minimum(most, gap[:, 0] - 1)), (np.maximum(least, np.maximum(gap[:, 0], gap[:, 1] + 1)), most)):
        for a in range(0, len(p), 2048):
            c = which[a:a + 2048]
            at, o, h = windows(c, first[c], last[c])
            lo = p[a + at] - o
            yield _rows(h, tid[a + at], lo, lo + length)


def _joined(tid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same texts with those that meet made one, so a long run is not carried as a span per byte."""
    if not len(tid):
        return tid, lo, hi
    order = np.lexsort((lo, tid))
    tid, lo, hi = tid[order], lo[order], hi[order]
    # Texts are set apart on one axis, so the furthest end so far never comes from another text.
    _, rank = np.unique(tid, return_inverse=True)
    base = rank * (int(hi.max()) + 2)
    far = np.maximum.accumulate(hi + base)
    head = np.flatnonzero(np.concatenate(([True], (lo + base)[1:] > far[:-1])))
    tail = np.append(head[1:], len(tid)) - 1
    return tid[head], lo[head], far[tail] - base[tail]


def _rows(h, tid, lo, hi) -> pa.RecordBatch:
    """A batch of (key, tid, lo, hi, n); an absent column is null."""
    n = len(tid) if tid is not None else len(h)
    column = lambda x: pa.nulls(n, pa.int64()) if x is None or len(x) < n else pa.array(x)
    return pa.RecordBatch.from_arrays([*map(column, (h, tid, lo, hi)), pa.array(np.ones(n, np.int64))], names=["key", "tid", "lo", "hi", "n"])


SPANS = "key long, tid long, lo long, hi long, n long"


def _spans(contexts: DataFrame, length: int, settle: bool) -> DataFrame:
    """Spans of contexts in key order, in chunks of bounded bytes; with ``settle`` chunks are of whole groups."""
    def weight(table: pa.Table) -> int:
        return table.num_rows * (length * 3 // 2 + 60) + 8 * (pc.sum(pc.list_value_length(table.column("p"))).as_py() or 0)

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                table = pa.Table.from_batches([batch.slice(at, 1024)])
                held.append(table)
                size += weight(table)
                if size < CHUNK_BYTES:
                    continue
                table = pa.concat_tables(held).combine_chunks()
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1])) if settle else len(key)  # the last group may go on
                if cut:
                    yield from _chunk_spans(table.slice(0, cut).combine_chunks(), length, settle)
                held = [table.slice(cut)]
                size = weight(held[0])
        if held and (table := pa.concat_tables(held).combine_chunks()).num_rows:
            yield from _chunk_spans(table, length, settle)

    return contexts.mapInArrow(run, SPANS)


def repeated_spans(df: DataFrame, text: str, length: int, work: Workspace, group_limit: int = GROUP_LIMIT,
                   segment: int = SEGMENT, by_word: bool = False) -> DataFrame:
    """(tid, spans): repeated byte ranges of every text that has any; ranges may overlap.

    ``by_word``: bytes are those of ``_word_names``, WORD for each word.
    """
    hits = work.write(_repeated(_indexed(df, text, length, segment, by_word)).select("key", "tid", "n"), "hits")
    # By occurrences: a gram may be frequent inside one text.
    heavy = hits.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > group_limit).select("key", F.lit(True).alias("heavy"))
    wanted = hits.drop("n").join(heavy, "key", "left").groupBy("tid").agg(
        F.collect_set(F.when(F.col("heavy").isNull(), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("heavy"), F.col("key"))).alias("heavy"))
    wanted = work.write(wanted, "wanted")
    # Of equal texts one stands for all; the copies are removed whole.
    texts = _packed(df, text).join(wanted, "tid").dropDuplicates(["tid"])
    contexts = _contexts(texts.select("tid", "z", "keys"), length, segment, by_word)
    found = _spans(contexts.repartition("key").sortWithinPartitions("key"), length, True).select("tid", "lo", "hi")
    if not wanted.where(F.size("heavy") > 0).isEmpty():
        large = texts.where(F.size("heavy") > 0).select("tid", "z", F.col("heavy").alias("keys"))
        parts = work.write(_spans(_contexts(large, length, segment, by_word), length, False), "parts")
        across = _repeated(parts.where("key IS NOT NULL")).where("tid IS NOT NULL")
        found = found.unionByName(parts.where("key IS NULL").select("tid", "lo", "hi")).unionByName(across.select("tid", "lo", "hi"))
    return found.groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merged(spans, size: int, whole: bool) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in ``spans``."""
    if whole:
        return [(0, size)] if size else []
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _placed(runs, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """The bytes of a text that ranges of ``_word_names`` stand for; white space goes where the words on both sides do."""
    whole = ({"lo": -(-s["lo"] // WORD), "hi": s["hi"] // WORD} for s in runs or ())
    return [{"lo": int(starts[a]), "hi": int(ends[b - 1])} for a, b in merged([s for s in whole if s["lo"] < s["hi"]], 0, False)]


def _named(df: DataFrame, text: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("_tid", T.LongType()), T.StructField("_size", T.LongType())])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, b, buf, offs in _batches(batch, at):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(text_name(buf, offs)), pa.array(np.diff(offs))], names=schema.names)

    return df.mapInArrow(run, schema)


def remove_repeats(df: DataFrame, text: str = "text", length: int = 400, group_limit: int = GROUP_LIMIT,
                   characters: bool = False, segment: int = SEGMENT, run_words: int | None = None) -> DataFrame:
    """Add ``_cut``: struct of removed runs and, as bytes, the kept rest of every row's text.

    With ``characters``, what a cut leaves of a character goes, too, so the rest is text. With ``run_words``, runs of so many
    words that also start anywhere else are removed as well, however few bytes they have. Both are judged on the input.
    """
    work = Workspace(df.sparkSession, "suffixes")
    spans = work.write(repeated_spans(df, text, length, work, group_limit, segment), "spans")
    if run_words:
        own = Workspace(df.sparkSession, "runs")
        runs = own.write(repeated_spans(df, text, run_words * WORD, own, group_limit, segment, True).withColumnRenamed("spans", "runs"), "runs")
        spans = spans.join(runs, "tid", "full")
    else:
        spans = spans.withColumn("runs", F.lit(None).cast(spans.schema["spans"].dataType))
    named = _named(df, text)
    copies = work.write(_named(df.select(text), text).groupBy("_tid").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "copies")
    marks = spans.join(copies, spans["tid"] == copies["_tid"], "full").select(
        F.coalesce("tid", "_tid").alias("_tid"), F.col("spans").alias("_spans"), F.col("runs").alias("_runs"), F.col("_n").isNotNull().alias("_whole"))
    schema = T.StructType([*df.schema.fields, T.StructField("_cut", T.StructType([
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))),
        T.StructField("kept", T.BinaryType())]))])
    names = df.columns

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            raw = buf.tobytes()
            marks = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_spans", "_runs", "_whole")))
            cuts = []
            for (own, runs, whole), a, b in zip(marks, offs[:-1].tolist(), offs[1:].tolist()):
                whole, long = bool(whole), b - a >= length
                if run_words and (runs or whole and not long):
                    starts, ends, _ = words(buf[a:b], np.array([0, b - a]))
                    own, long = [*(own or ()), *_placed(runs, starts, ends)], long or len(starts) >= run_words
                gone = merged(own, b - a, whole and long)
                edges = [0, *(e for run_ in gone for e in run_), b - a]
                rest = [raw[a + lo:a + hi] for lo, hi in zip(edges[::2], edges[1::2])]
                if characters and gone:
                    rest = [r.decode("utf-8", "ignore").encode() for r in rest]
                cuts.append({"removed": [{"lo": lo, "hi": hi} for lo, hi in gone],
                             "kept": b"".join(rest)})
            kind = pa.struct([("removed", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("kept", pa.binary())])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(cuts, kind)], names=[*names, "_cut"])

    return named.join(marks, "_tid", "left").mapInArrow(run, schema)


def digest(rows: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = F.aggregate("_cut.removed", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return rows.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), gone.alias("n_removed"),
        F.size("_cut.removed").cast("long").alias("n_spans"), F.sha2("_cut.kept", 256).alias("kept_sha256"))
