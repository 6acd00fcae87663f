"""Byte-level BPE over a rank file: a perfect hash for whole pre-tokens, a heap for the rest.

Texts are cut into pre-tokens on arrays of character classes, a whole batch at a time. Tier one looks
every pre-token up in a minimal perfect hash of the vocabulary and compares the bytes, so a hit
is certain; a pre-token that is in the vocabulary is its own encoding. Tier two merges the
others: their bytes form a linked list, candidate pairs wait in a heap by rank, and merges that
went stale are skipped. A miss seen before in the worker is taken from a bounded memory.

The vocabulary (about 50,000 entries, its size fixed by the file) is what is sent to the tasks. Null
text is empty text and gives no ids. Other columns, ids included, pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evenfold.llm.spans import SpanHash, mix, pieces, utf8

PIECE_BYTES = 1 << 20
REMEMBERED = 250_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """A minimal perfect hash by displacement: keys share a bucket, each bucket finds a shift that
    sends all its keys to free slots; buckets are placed from the largest down. A bucket of one key
    takes any slot that is left and keeps the slot itself."""

    def __init__(self, hashes: np.ndarray, seed: int = 0):
        n = len(hashes)
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, dtype=np.uint64)
        self.slot_of = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        tries = np.arange(1, 129, dtype=np.uint64)
        for b in np.argsort(-counts, kind="stable"):
            if counts[b] < 2:
                break
            keys = order[ends[b] - counts[b]:ends[b]]
            first = np.uint64(0)
            while True:
                shifts = tries + first
                slots = self._slots(hashes[keys][:, None], shifts[None, :])
                fits = free[slots].all(axis=0)
                ordered = np.sort(slots, axis=0)
                fits &= (ordered[1:] != ordered[:-1]).all(axis=0)
                hit = int(fits.argmax())
                if fits[hit]:
                    break
                first += np.uint64(len(tries))
            self.shift[b] = shifts[hit]
            self.slot_of[keys] = slots[:, hit]
            free[slots[:, hit]] = False
        self.single = counts == 1
        alone = order[ends[self.single] - 1]
        self.slot_of[alone] = np.flatnonzero(free)
        self.shift[self.single] = self.slot_of[alone].astype(np.uint64)

    def _slots(self, hashes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        return (mix(hashes ^ (shifts * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        shift = self.shift[bucket]
        return np.where(self.single[bucket], shift.astype(np.int64), self._slots(hashes, shift))


class Vocabulary:
    """Tokens, their perfect hash and the rank of every mergeable pair's result."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.names = [str(i) for i in range(len(tokens))]
        self.buf = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        hashes = SpanHash(self.buf, seed=7)(self.starts, self.ends)
        self.hash = PerfectHash(hashes)
        self.at = np.empty(len(tokens), dtype=np.int64)
        self.at[self.hash.slot_of] = np.arange(len(tokens))

    def find(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each span that is a token, else -1; bytes are compared."""
        found = self.at[self.hash(hashes)]
        length = ends - starts
        same = length == self.ends[found] - self.starts[found]
        rows = np.flatnonzero(same)
        n = length[rows]
        total = int(n.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        differ = buf[np.repeat(starts[rows], n) + inside] != self.buf[np.repeat(self.starts[found[rows]], n) + inside]
        wrong = np.repeat(rows, n)[differ]
        same[wrong] = False
        return np.where(same, found, -1)


def merge_bytes(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of pairs over a linked list of byte runs."""
    n = len(piece)
    following = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))  # 0 marks a run that was merged away
    get = rank.get
    heap = []
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = following[i]
        if not end[i] or j >= n or end[j] != stop:
            continue  # stale: one of the two runs has changed
        end[i], end[j] = stop, 0
        k = following[i] = following[j]
        if k < n:
            before[k] = i
            r = get(piece[i:end[k]])
            if r is not None:
                heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0:
            r = get(piece[h:stop])
            if r is not None:
                heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i:end[i]]])
        i = following[i]
    return out


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point under the pattern's own engine."""
    if not _CLASSES:
        points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text, table = "".join(points), np.zeros(0x110000, dtype=np.uint8)
        at = np.fromiter(map(ord, points), np.int64, len(points))
        for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(name, text):
                table[at[m.start():m.end()]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte where each begins."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(at) == len(buf):
        return buf.astype(np.int32), at
    lead = buf[at].astype(np.int32)
    wide = np.zeros(len(buf) + 3, dtype=np.int32)
    wide[:len(buf)] = buf & 0x3F
    two = ((lead & 0x1F) << 6) | wide[at + 1]
    three = ((lead & 0x0F) << 12) | (wide[at + 1] << 6) | wide[at + 2]
    four = ((lead & 0x07) << 18) | (wide[at + 1] << 12) | (wide[at + 2] << 6) | wide[at + 3]
    return np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, two, three], four), at


#: The endings that the pattern cuts off after an apostrophe, in its order.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def pre_tokens(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches among code points; ``heads`` are where texts begin.

    Matches are runs of one class. A run of letters, numbers or others takes one blank before it. The last
    white space before such a run stands alone unless it is that blank; white space that ends a text
    is one match. A lone apostrophe that took no blank takes an ending from the letters after it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    head = np.zeros(n + 1, dtype=bool)
    head[heads[heads < n]] = True
    head[n] = True
    begin = np.ones(n, dtype=bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= head[:n]
    white = kind == SPACE
    # Last white space of a run with something of the same text after it.
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[-1] = False
    last &= ~head[1:]
    begin |= last
    blank = last & (points == 32)
    taken = np.flatnonzero(blank) + 1
    begin[taken] = False
    # Contractions.
    quote = np.flatnonzero((points == 39) & begin[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~head[quote + 1]]
    padded = np.append(points, (0, 0))
    stop = np.append(head, (True, True))
    left = np.ones(len(quote), dtype=bool)
    for ending in ENDINGS:
        match = left & (padded[quote + 1] == ord(ending[0]))
        if len(ending) == 2:
            match &= (padded[quote + 2] == ord(ending[1])) & ~stop[quote + 2]
        q = quote[match]
        begin[q + 1] = False
        after = q + 1 + len(ending)
        begin[after[after < n]] = True
        left &= ~match
    return np.flatnonzero(begin)


def _told_apart(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, example: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that only share a hash with their example become examples of their own."""
    size, like = ends - starts, example[which]
    differs = size != size[like]
    rows = np.flatnonzero(~differs & (like != np.arange(len(like))))
    for part in np.array_split(rows, max(1, int(size[rows].sum()) >> 20)):
        n = size[part]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unlike = buf[np.repeat(starts[part], n) + inside] != buf[np.repeat(starts[like[part]], n) + inside]
        differs[np.repeat(part, n)[unlike]] = True
    own = np.flatnonzero(differs)
    which = which.copy()
    which[own] = len(example) + np.arange(len(own))
    return np.concatenate((example, own)), which


class Encoder:
    """Encodes batches; remembers merged pre-tokens in two generations of bounded size."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.limit = vocabulary, remembered // 2
        self.young: dict[bytes, list[int]] = {}
        self.old: dict[bytes, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = merge_bytes(piece, self.v.rank)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and n + 1 offsets of the rows' ids."""
        points, at = code_points(buf)
        heads = np.searchsorted(at, offs[:-1])
        first = pre_tokens(points, heads)
        starts = at[first]
        ends = np.append(starts[1:], len(buf))
        hashes = SpanHash(buf, seed=7)(starts, ends)
        found = self.v.find(hashes, buf, starts, ends)
        missing = np.flatnonzero(found < 0)
        # Equal misses are encoded once: one example per hash, and one more for each that differs from it in a byte.
        other = SpanHash(buf, seed=11).raw(starts[missing], ends[missing])
        key = mix(hashes[missing]) ^ other
        _, example, which = np.unique(key, return_index=True, return_inverse=True)
        example, which = _told_apart(buf, starts[missing], ends[missing], example, which)
        raw = buf.tobytes()
        lists = [self.merged(raw[a:b]) for a, b in zip(starts[missing[example]].tolist(), ends[missing[example]].tolist())]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum()))
        base = np.cumsum(sizes) - sizes
        count = np.ones(len(starts), dtype=np.int64)
        count[missing] = sizes[which]
        upto = np.cumsum(count)
        ids = np.empty(int(upto[-1]) if len(upto) else 0, dtype=np.int32)
        hit = np.flatnonzero(found >= 0)
        ids[upto[hit] - 1] = found[hit]
        n = count[missing]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids[np.repeat(upto[missing] - n, n) + inside] = flat[np.repeat(base[which], n) + inside]
        token_rows = np.searchsorted(starts, offs)
        return ids, np.concatenate(([0], upto))[token_rows]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, read on the driver and sent once to each executor."""
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def encode(df: DataFrame, shared: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace or add ``ids``: array<int> of every whole text; all other columns stay."""
    kept = [f for f in df.schema.fields if f.name != ids]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared)
        for batch in batches:
            buf, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            for a, b in pieces(offs, PIECE_BYTES):
                found, at = coder.encode(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], lists], names=[*names, ids])

    return df.mapInArrow(run, schema)


def decode(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def digests(df: DataFrame, shared: Broadcast, ids: str = "ids") -> DataFrame:
    """Replace ``ids`` by n_tokens, ids_sha256 and the sha256 of the bytes decoded from the ids."""
    kept = [f for f in df.schema.fields if f.name not in (ids, "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            values, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            n, named, decoded = [], [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                own = values[a:b].tolist()
                n.append(b - a)
                named.append(hashlib.sha256(",".join(map(v.names.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(own, v.tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(n, pa.int64()), pa.array(named, pa.string()),
                 pa.array(decoded, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
