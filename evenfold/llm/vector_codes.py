"""Vector codes: parts of vectors replaced by the number of the nearest entry of a small codebook.

The nearest entry is found by slicing and intersecting. For each dimension of a part the entries' coordinates are
sorted, and each prefix of that order carries the mask of its entries. The distance to the entry nearest
along the widest dimension is an initial radius: every entry at least as near lies inside the cube of that
radius. Per dimension, two binary searches give the range of coordinates inside it and the
difference of two prefix masks its entries; the masks of all dimensions, ANDed as uint64, leave the candidates, whose exact
distances decide. So no entry at least as near is missed, and ties go to the lower index.

Codebooks are learnt in rounds over all vectors: each task adds up its vectors per entry and sends one row per
entry and position; sums meet as exact integers. Vectors are packed once into blocks, so a round reads compact numbers.

Components become floor(scale * x), cut to +-2**62. Rows whose vector is null or has a null or non-finite
component are dropped. Shorter vectors, and a length that the parts do not divide, are filled up with zeros. With fewer rows than entries the codebooks are
smaller. Repeated ids are rows of their own, a null id orders last, and of equal ids the smaller vector comes first.
Errors beyond 64 bits are cut to the largest long. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.llm.tables import Workspace
from evenfold.llm.vector_file import usable
from evenfold.operators.joins import join_by_weight
from evenfold.session import BROADCAST_ROWS

LIMIT, LARGEST = 1 << 62, (1 << 63) - 1
VECTORS_PER_BLOCK = 4096


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers, cut to the limit."""
    return np.clip(np.floor(x * float(scale)), -float(LIMIT), float(LIMIT)).astype(np.int64)


def _matrix(column: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), dims), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    inside = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), inside] = whole(values, scale)
    return out


def pack(kept: DataFrame, dims: int, scale: int, per_block: int) -> DataFrame:
    """(ids, labels, width, packed): blocks of vectors in the narrowest integers that hold them."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                part = batch.slice(at, per_block)
                v = _matrix(pa.concat_arrays([part.column(2)]), dims, scale)
                top = int(np.abs(v).max(initial=0))
                width = next(w for w in (2, 4, 8) if top < 1 << 8 * w - 1)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(c)])) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([width], pa.int32()), pa.array([v.astype(f"<i{width}").tobytes()], pa.binary())],
                                                 names=["ids", "labels", "width", "packed"])

    types = [kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return kept.mapInArrow(run, f"ids array<{types[0]}>, labels array<{types[1]}>, width int, packed binary")


class Slices:
    """The entries of one part, at most 64, in sorted coordinates with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        self.prefix = np.vstack([np.zeros((1, entries.shape[1]), np.uint64), np.bitwise_or.accumulate(bits, axis=0)])
        self.widest = int(np.argmax(self.sorted[-1] - self.sorted[0])) if entries.size else 0

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of each row in every dimension."""
        mask = np.full(len(x), np.uint64((1 << len(self.entries)) - 1), np.uint64)
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[high, d] & ~self.prefix[low, d]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, exact."""
        best = np.zeros(len(x), np.int64)
        if x.shape[1] == 0:
            return best, np.zeros(len(x), np.int64)
        along = self.sorted[:, self.widest]
        at = np.clip(np.searchsorted(along, x[:, self.widest]), 1, max(1, len(along) - 1))
        nearer = np.abs(x[:, self.widest] - along[at - 1]) <= np.abs(along[np.minimum(at, len(along) - 1)] - x[:, self.widest])
        best = self.order[np.where(nearer, at - 1, np.minimum(at, len(along) - 1)), self.widest]
        least = _squares(x, self.entries[best])
        # One more than the root's floor, so that rounding cannot lose an entry.
        radius = (np.array([math.isqrt(int(v)) + 1 for v in least], object) if x.dtype == object
                  else np.sqrt(least.astype(np.float64)).astype(np.int64) + 1)
        mask = self.candidates(x, radius)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(mask & np.uint64(1 << e))
            far = _squares(x[rows], self.entries[e])
            better = (far < least[rows]) | ((far == least[rows]) & (e < best[rows]))
            best[rows[better]], least[rows[better]] = e, far[better]
        return best, least


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return (gap * gap).sum(axis=1)


class Codebooks:
    """One codebook per part position, entries as tuples of exact integers."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries

    @classmethod
    def first(cls, vectors: np.ndarray, parts: int) -> Codebooks:
        return cls([p.tolist() for p in np.split(vectors, parts, axis=1)])

    def moved(self, sums: dict[tuple[int, int], tuple[dict[int, int], int]]) -> Codebooks:
        """Entries replaced by the floor of their mean; unused entries stay."""
        return Codebooks([[[sums[p, e][0].get(d, 0) // sums[p, e][1] for d in range(len(entry))] if (p, e) in sums else entry
                           for e, entry in enumerate(book)] for p, book in enumerate(self.entries)])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()

    def slicer(self, dims: int):
        """A function from a matrix of vectors to (index, squared distance) per part; whole numbers of any size."""
        top = max((abs(x) for book in self.entries for entry in book for x in entry), default=0)
        made: dict[type, list[Slices]] = {}

        def assign(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            reach = max(top, int(np.abs(v).max(initial=0)))
            kind = np.int64 if 4 * reach * reach * max(1, dims) < LARGEST else object
            if kind not in made:
                made[kind] = [Slices(np.array(book, dtype=kind).reshape(len(book), dims // len(self.entries))) for book in self.entries]
            split = np.split(v.astype(kind), len(self.entries), axis=1)
            return [(x, *own.nearest(x)) for own, x in zip(made[kind], split)]

        return assign


def _vectors(batches, dims: int):
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for at in range(batch.num_rows):
            raw = columns["packed"][at].as_py()
            # A length of no dimensions leaves no bytes to count rows by.
            n = len(columns["ids"][at]) if "ids" in columns else len(raw) // max(1, dims * columns["width"][at].as_py())
            yield columns, at, np.frombuffer(raw, f"<i{columns['width'][at].as_py()}").reshape(n, dims).astype(np.int64)


def _sums(blocks: DataFrame, books: Codebooks, dims: int) -> dict[tuple[int, int], tuple[dict[int, int], int]]:
    """Sums and counts per (part, entry): as many rows as the codebooks have numbers reach the driver."""
    def run(batches):
        assign = books.slicer(dims)
        total: dict[tuple[int, int], list] = {}
        for _, _, v in _vectors(batches, dims):
            for p, (x, index, _) in enumerate(assign(v)):
                for e in np.unique(index).tolist():
                    own = x[index == e]
                    wide = own.dtype == object or int(np.abs(own).max(initial=0)) * len(own) >= LARGEST
                    s = [int(c) for c in (own.astype(object) if wide else own).sum(axis=0)]
                    held = total.setdefault((p, e), [[0] * len(s), 0])
                    held[0], held[1] = [a + b for a, b in zip(held[0], s)], held[1] + len(own)
        # Sums travel as two halves, so that adding them in Spark stays exact.
        rows = [(p, e, d, x >> 32, x & 0xFFFFFFFF, n) for (p, e), (s, n) in total.items() for d, x in enumerate(s)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 3 + [pa.int64()] * 3)],
                                             names=["part", "entry", "at", "high", "low", "n"])

    halves = blocks.select("width", "packed").mapInArrow(run, "part int, entry int, at int, high long, low long, n long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    out: dict[tuple[int, int], tuple[dict[int, int], int]] = {}
    for r in halves.groupBy("part", "entry", "at").agg(*wide, F.sum("n").alias("n")).collect():
        out.setdefault((r["part"], r["entry"]), ({}, r["n"]))[0][r["at"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


def _coded(blocks: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    def run(batches):
        assign = books.slicer(dims)
        for columns, at, v in _vectors(batches, dims):
            found = assign(v)
            codes = np.stack([index for _, index, _ in found], axis=1).astype(np.uint8)
            error = sum(least.astype(object) if least.dtype == object else least for _, _, least in found)
            hexed = codes.tobytes().hex()
            step = 2 * len(found)
            yield pa.RecordBatch.from_arrays(
                [columns["ids"][at].values, columns["labels"][at].values, pa.array([hexed[k * step:k * step + step] for k in range(len(v))]),
                 pa.array([min(LARGEST, int(x)) for x in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    types = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    return blocks.mapInArrow(run, f"vec_id {types[0]}, label {types[1]}, code string, error long")


def compress(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096,
             parts: int = 8, entries: int = 16, rounds: int = 6, per_block: int = VECTORS_PER_BLOCK) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 per kept row."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries, one bit each")
    work = Workspace(df.sparkSession, "codes")
    kept = df.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    kept = kept.where(usable(F.col("v"))).withColumn("v", F.col("v").cast("array<double>"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    start = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    heads = np.zeros((len(start), dims), np.int64)
    for k, r in enumerate(start):
        heads[k, :len(r["v"])] = whole(np.array(r["v"], np.float64), scale)
    books = Codebooks.first(heads, parts)
    blocks = work.write(pack(kept, dims, scale, per_block), "blocks")
    for _ in range(rounds if dims else 0):
        books = books.moved(_sums(blocks, books, dims))
    coded = work.write(_coded(blocks, books, dims), "coded")
    errors = coded.groupBy(F.col("label").alias("_label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    errors = work.write(errors, "errors")
    if errors.count() <= BROADCAST_ROWS:
        summed = coded.join(F.broadcast(errors), F.col("label").eqNullSafe(F.col("_label")))
    else:
        summed = join_by_weight(coded, errors.withColumnRenamed("_label", "label"), ["label"], "_n", "code")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
