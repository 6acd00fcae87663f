"""Exact top-k inner products with a vector-approximation file.

Every vector is stored a second time as the numbers of the cells it falls in, a few bits a dimension. A cell has
a lowest and a highest value, so query times cells bounds the score from both sides. The first pass
scans only the approximations, in blocks of queries against blocks of vectors, and keeps what
could still be among the best: its upper bound reaches the k-th best lower bound met so far. The bounds of all
blocks are then joined per query, and exact vectors are read in order of their bounds until the next upper bound
is below the k-th exact score. Equal bounds are read, so ties go to the smaller id.

Components become floor(scale * x). A vector that is null or has a null or non-finite component takes no part;
vectors of different length meet as if padded with zeros. Scores are 64-bit integers, cut to their range. A query's own id is never
its candidate; of repeated ids, as query or candidate, all rows are scored and the best score of the two ids counts once. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenfold.llm.tables import Workspace

VECTORS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512


def usable(vector: Column) -> Column:
    """Not null and all components finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(df: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): usable vectors as integers."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return df.where(usable(F.col(vector)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))


def grid(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component of every dimension: one row per dimension reaches the driver."""
    found = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x"), F.max("x")).orderBy("d").collect()
    low = np.array([r[1] for r in found], dtype=np.int64)
    return np.minimum(low, 0), np.maximum(np.array([r[2] for r in found], dtype=np.int64), 0)


class Cells:
    """Cells of equal width over each dimension's range."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        # A range may be wider than 63 bits: widths come from whole numbers of any size.
        widths = [-((int(a) - int(b) - 1) // (1 << bits)) for a, b in zip(low.tolist(), high.tolist())]
        self.low, self.width = low, np.array(widths, dtype=np.uint64)
        self.widest = np.maximum(-low.astype(np.float64), high)

    def encode(self, v: np.ndarray) -> np.ndarray:
        return ((v.astype(np.uint64) - self.low.astype(np.uint64)) // self.width).astype(np.uint8)

    def middle(self, cells: np.ndarray) -> np.ndarray:
        """Middle of the integers in each cell; the farthest of them is (width - 1) / 2 away."""
        width = self.width.astype(np.float64)
        return self.low + cells * width + (width - 1) / 2


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    offs = column.offsets.to_numpy()
    size = np.diff(offs)
    out = np.zeros((len(size), dims), dtype=np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), inside] = column.values.to_numpy()[offs[0]:offs[-1]]
    return out


def _blocks(vectors: DataFrame, dims: int, per_block: int, cells: Cells | None) -> DataFrame:
    """(b, ids, packed): neighbouring rows with one ``b`` gathered to blocks, as cell numbers or as integers."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            b = batch.column(2).to_numpy()
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(b)), bool), b[1:] != b[:-1])))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(b)]):
                for s in range(start, stop, per_block):
                    part = batch.slice(s, min(per_block, stop - s))
                    v = _matrix(pa.concat_arrays([part.column(1)]), dims)
                    packed = cells.encode(v) if cells else v
                    yield pa.RecordBatch.from_arrays([pa.array([b[start]]), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()),
                                                      pa.array([packed.tobytes()], pa.binary())], names=["b", "ids", "packed"])

    return vectors.select("vec_id", "v", "b").mapInArrow(run, "b long, ids binary, packed binary")


def _bounds(pairs: DataFrame, dims: int, k: int, cells: Cells) -> DataFrame:
    """Scan block pairs; per query, the candidates that its own blocks cannot rule out."""
    half = (cells.width.astype(np.float64) - 1) / 2
    edge = 2.0 ** 63  # scores are cut to 64 bits, so bounds are as well

    def run(batches):
        for batch in batches:
            for qi, qv, ci, cv in zip(*(c.to_pylist() for c in batch.columns)):
                q_id, c_id = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                q = np.frombuffer(qv, np.int64).reshape(-1, dims).astype(np.float64)
                middle = cells.middle(np.frombuffer(cv, np.uint8).reshape(-1, dims))
                score = q @ middle.T
                # Wider than the rounding of the sums.
                slack = np.abs(q) @ (half + cells.widest * 1e-12) + 1
                own = q_id[:, None] == c_id[None, :]
                least = np.clip(score - slack[:, None], -edge, edge)
                most = np.clip(score + slack[:, None], -edge, edge)
                least[own] = -np.inf
                best = min(k, score.shape[1])
                # A block with a repeated id rules nothing out: k rows need not be k ids.
                sure = best == k and len(np.unique(c_id)) == len(c_id)
                kth = -np.partition(-least, best - 1, axis=1)[:, best - 1] if sure else np.full(len(q), -np.inf)
                row, col = np.nonzero((most >= kth[:, None]) & ~own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_id[row]), pa.array(c_id[col]), pa.array(least[row, col]), pa.array(most[row, col])],
                    names=["query_id", "vec_id", "low", "high"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, low double, high double")


def top_k(df: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256, bits: int = 6,
          vectors_per_block: int = VECTORS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each query; ``queries`` is a condition on ``vec_id``."""
    work = Workspace(df.sparkSession, "vectors")
    vectors = work.write(integers(df, id_column, vector, scale), "vectors")
    low, high = grid(vectors)
    dims = max(1, len(low))
    if not len(low):
        low, high = np.zeros(1, np.int64), np.zeros(1, np.int64)
    cells = Cells(low, high, bits)
    approximations = work.write(_blocks(vectors.withColumn("b", F.lit(0).cast("long")), dims, vectors_per_block, cells), "approximations")
    # The stated queries against all rows, block by block: a block of queries meets every block of cells once.
    n = max(1, -(-vectors.where(queries).count() // queries_per_block))
    dealt = vectors.where(queries).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n))).repartition("b").sortWithinPartitions("b")
    asked = work.write(_blocks(dealt, dims, queries_per_block, None).select("b", F.col("ids").alias("q_ids"), F.col("packed").alias("q")), "queries")
    spread = approximations.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    pairs = spread.join(asked, "b").select("q_ids", "q", "ids", "packed")
    scanned = work.write(_bounds(pairs, dims, k, cells), "scanned")
    # The k-th best lower bound over all blocks, by ids.
    scanned = scanned.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    floor = scanned.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("low").alias("_low"))
    left = scanned.join(floor, "query_id").where((F.col("_n") < k) | (F.col("high") >= F.col("_low"))).select("query_id", "vec_id", "high")
    asked_v = vectors.where(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    read = left.join(vectors, "vec_id").join(asked_v, "query_id")

    def refine(batches):
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            q_id, c_id, bound = c["query_id"].to_numpy(), c["vec_id"].to_numpy(), c["high"].to_numpy()
            q, v = c["q"].to_pylist(), c["v"].to_pylist()
            keep, score, best, at = [], [], [], None
            for i in range(len(q_id)):
                if q_id[i] != at:
                    at, best = q_id[i], []
                if len(best) == k and bound[i] < best[-1][0]:
                    continue  # bounds fall: nothing that follows can be better
                s = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q[i], v[i]))))
                keep.append(i)
                score.append(s)
                known = [b for b in best if b[1] == c_id[i]]
                # Of equal scores the smaller id is the better one.
                best = sorted([*(b for b in best if b[1] != c_id[i]), max([(s, c_id[i]), *known])], key=lambda b: (-b[0], b[1]))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(q_id[keep]), pa.array(c_id[keep]), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    exact = read.repartition("query_id").sortWithinPartitions("query_id", F.desc("high")).mapInArrow(refine, "query_id long, vec_id long, score long")
    exact = exact.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
