"""A hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class factor is log-linear: hashed features of the
history (the last word, the last two, the one before it alone, and one two places further back) each add a row of
weights over the classes, and softmax over the classes normalises exactly. The word factor has the word itself as its
only feature, for which the maximum-entropy solution is the smoothed relative frequency inside the class, with
one place for unknown words. The most frequent words are classes of their own; all others share classes by
their first letters, so an unknown word has a class, too.

Training reads every training token in every round. Tasks count how often each feature meets each class and sum what the
current model expects; the difference is the gradient of the log-likelihood. Tables have a fixed size (ROWS x classes),
are summed by a shuffle over row blocks, and only the sum reaches the driver. Steps are scaled per weight.

Texts are tokenised once, to chunks that hold a dictionary of their own; global counts come from the chunks'
dictionaries and are joined back to them, so traffic follows the distinct words of a chunk, not its tokens.

Words are 64-bit hashes. Null text is empty: its one token is the end. Null ids fall into the training rows by the rule
for empty id text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.llm.spans import SpanHash, mix, pieces, utf8, words
from evenfold.llm.tables import Workspace

CHUNK_BYTES = 1 << 24
ROWS = 1 << 14
OWN_CLASSES, SHARED_CLASSES = 24, 40
CLASSES = OWN_CLASSES + SHARED_CLASSES
FEATURES = 4
ROUNDS = 2
BATCH = 1 << 15  # tokens whose chances are held at once: 8 MB
COUNTED = 1 << 18  # tokens counted at once: a few arrays of 2 MB
PRIOR = 4.0
#: A task has fewer chunks, a chunk fewer words, than these bits count.
CHUNK_BITS, WORD_BITS = 14, 25
END = np.int64(0x454E44)
_U = np.uint64


def _press(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _open(z: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(z), dtype=kind)


def tokenise(df: DataFrame, id_column: str, text: str, held_out: Column) -> DataFrame:
    """One row per chunk: ids, fold and token count of its texts, its dictionary, its tokens."""
    kind = df.schema[id_column].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("doc_id", T.ArrayType(kind)), T.StructField("held_out", T.ArrayType(T.BooleanType())),
        T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()), T.StructField("prefix", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("tokens", T.BinaryType())])

    def chunk_row(seq: int, parts: list) -> pa.RecordBatch:
        ids, held = pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts])
        n, h, prefix = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        own, first, token = np.unique(h, return_index=True, return_inverse=True)
        trained = np.repeat(~held.to_numpy(zero_copy_only=False), n)
        counts = np.bincount(token[trained], minlength=len(own))
        one = np.array([0, len(ids)], dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(one), x) for x in (ids, held, pa.array(n.astype(np.int32)))]
        packed = [_press(own), _press(prefix[first]), _press(counts), _press(token.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << CHUNK_BITS | seq]), *lists, *[pa.array([x], pa.binary()) for x in packed]], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]):
        parts, size, seq = [], 0, 0
        for batch in batches:
            buf, offs = utf8(batch.column(2))
            for a, b in pieces(offs):
                piece, at = buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
                starts, ends, rows = words(piece, at)
                h = SpanHash(piece, seed=3, lower=True)(starts, ends)
                # The first three bytes stand for the word's beginning.
                head = SpanHash(piece, seed=29, lower=True)(starts, np.minimum(starts + 3, ends)) % _U(SHARED_CLASSES)
                n = np.diff(rows) + 1
                with_end = np.full(len(h) + b - a, END)
                prefix = np.zeros(len(with_end), dtype=np.uint8)
                place = np.arange(len(h)) + np.repeat(np.arange(b - a), n - 1)
                with_end[place], prefix[place] = h.view(np.int64), head
                parts.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), n, with_end, prefix))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield chunk_row(seq, parts)
                    parts, size, seq = [], 0, seq + 1
        if parts:
            yield chunk_row(seq, parts)

    return df.select(F.col(id_column), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text)).mapInArrow(run, schema)


def _dictionary(chunks: DataFrame) -> DataFrame:
    """(word, slot, prefix, n) of every chunk's dictionary; the slot is the chunk and the place in it."""
    def run(batches):
        for batch in batches:
            for chunk, w, p, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = _open(w, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own), pa.array((chunk << WORD_BITS) + np.arange(len(own))),
                    pa.array(_open(p, np.uint8).astype(np.int8)), pa.array(_open(n, np.int64))], names=["word", "slot", "prefix", "n"])

    return chunks.select("chunk", "words", "prefix", "counts").mapInArrow(run, "word long, slot long, prefix byte, n long")


def _gathered(rows: DataFrame) -> DataFrame:
    """(chunk, c): the counts of a chunk's words in their order, streamed."""
    def run(batches):
        chunk, parts = None, []
        for batch in batches:
            own, c = batch.column(0).to_numpy() >> WORD_BITS, batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if parts and own[a] != chunk:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([_press(np.concatenate(parts))], pa.binary())], names=["chunk", "c"])
                    parts = []
                chunk = int(own[a])
                parts.append(c[a:b])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([_press(np.concatenate(parts))], pa.binary())], names=["chunk", "c"])

    return rows.select("slot", "c").repartition(F.shiftright("slot", WORD_BITS)).sortWithinPartitions("slot").mapInArrow(run, "chunk long, c binary")


def _classes(own: np.ndarray, prefix: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The class of each word of a dictionary; ``top`` are the sorted words with their own, END among them."""
    at = np.minimum(np.searchsorted(top, own), max(0, len(top) - 1))
    return np.where(top[at] == own, at, OWN_CLASSES + prefix.astype(np.int64)) if len(top) else OWN_CLASSES + prefix.astype(np.int64)


class _History:
    """Hashed feature rows of the tokens of a chunk, made for a slice of tokens at a time."""

    def __init__(self, own: np.ndarray, token: np.ndarray, n: np.ndarray):
        self.mixed, self.token = mix(own.view(_U)), token
        self.starts = np.cumsum(n) - n

    def features(self, a: int, b: int) -> np.ndarray:
        """Feature rows (FEATURES x tokens) of tokens ``a`` to ``b``: what stands before them in their texts."""
        here = np.arange(a, b)
        place = here - self.starts[np.searchsorted(self.starts, here, "right") - 1]
        x = self.mixed[self.token[max(0, a - 3):b]]

        def back(k: int) -> np.ndarray:
            out = np.full(b - a, _U(k), dtype=_U)
            some = x[:len(x) - k][-(b - a):]
            out[b - a - len(some):] = some
            return np.where(place >= k, out, _U(k))

        one, two, three = back(1), back(2), back(3)
        raw = [one, two * _U(0x9E3779B97F4A7C15) + _U(1), mix(one * _U(3) + two), three * _U(0xD1342543DE82EF95) + _U(2)]
        return np.stack([(mix(r + _U(k)) & _U(ROWS - 1)).astype(np.int64) for k, r in enumerate(raw)])


def _chance(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Softmax over classes (CLASSES x tokens) for a batch of feature rows.

    ``weights`` is CLASSES x ROWS: the weights of one class stay in the cache while they are looked up.
    """
    s = np.empty((len(weights), f.shape[1]), dtype=np.float32)
    more = np.empty(f.shape[1], dtype=np.float32)
    for own, w, b in zip(s, weights, bias):
        np.take(w, f[0], out=own, mode="clip")
        own += b
        for k in range(1, FEATURES):
            own += np.take(w, f[k], out=more, mode="clip")
    s -= s.max(axis=0)
    np.exp(s, out=s)
    s /= s.sum(axis=0)
    return s


def _add_chances(table: np.ndarray, f: np.ndarray, chance: np.ndarray) -> None:
    """Add each token's chances (CLASSES x tokens) to ``table`` (CLASSES x ROWS) at all of its feature rows."""
    for total, own in zip(table, chance):
        own = own.astype(np.float64)
        for rows in f:
            total += np.bincount(rows, own, table.shape[1])


def _sums(chunks: DataFrame, top: np.ndarray, model: Broadcast | None) -> np.ndarray:
    """Table (ROWS x CLASSES) of feature-class counts of all training tokens, or of the model's expectations."""
    blocks = 64

    def run(batches):
        table = np.zeros((CLASSES, ROWS) if model else (ROWS, CLASSES))
        for batch in batches:
            for held, n, w, p, t in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = _open(w, np.int64)
                cls, token, n = _classes(own, _open(p, np.uint8), top), _open(t, np.int32), np.array(n)
                history = _History(own, token, n)
                keep = np.repeat(~np.array(held, dtype=bool), n)
                size = BATCH if model else COUNTED
                for s in range(0, len(token), size):
                    kept = keep[s:s + size]
                    part = history.features(s, min(len(token), s + size))[:, kept]
                    if model is None:
                        c = cls[token[s:s + size][kept]]
                        for k in range(FEATURES):
                            table += np.bincount(part[k] * CLASSES + c, minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)
                        continue
                    if part.shape[1]:
                        _add_chances(table, part, _chance(*model.value, part))
        for b, rows in enumerate(np.split((table.T if model else table).astype(np.float32, order="C"), blocks)):
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_press(rows)], pa.binary())], names=["b", "z"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[b] = held.get(b, 0) + _open(z, np.float32).astype(np.float64)
        for b, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_press(total)], pa.binary())], names=["b", "z"])

    parts = chunks.select("held_out", "n", "words", "prefix", "tokens").mapInArrow(run, "b int, z binary")
    out = np.zeros((ROWS, CLASSES))
    for row in parts.repartition("b").mapInArrow(add, "b int, z binary").collect():  # the table itself, of fixed size
        out.reshape(blocks, -1)[row["b"]] += _open(row["z"], np.float64)
    return out


def train(chunks: DataFrame, top: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (CLASSES x ROWS) and bias: started at the features' own log ratios, then moved along the scaled gradient."""
    seen = _sums(chunks, top, None)
    share = seen.sum(axis=0) + 1
    share /= share.sum()
    bias = np.log(share).astype(np.float32)
    row = seen.sum(axis=1, keepdims=True)
    weights = (np.log((seen + PRIOR * share) / ((row + PRIOR) * share)) / FEATURES * 1.5).astype(np.float32)
    context = chunks.sparkSession.sparkContext
    for _ in range(rounds):
        model = context.broadcast((np.ascontiguousarray(weights.T), bias))
        expected = _sums(chunks, top, model)
        step = (seen - expected) / (np.maximum(seen, expected) + PRIOR)
        weights = (weights + step / 2).astype(np.float32)
        model.unpersist()
    return np.ascontiguousarray(weights.T), bias


def score(df: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark = df.sparkSession
    work = Workspace(spark, "maxent")
    chunks = work.write(tokenise(df, id_column, text, held_out), "chunks")
    vocabulary = work.write(_dictionary(chunks).groupBy("word").agg(F.sum("n").alias("c"), F.min("prefix").alias("prefix")), "vocabulary")
    known = vocabulary.where("c > 0")
    frequent = [r["word"] for r in known.where(F.col("word") != F.lit(int(END))).orderBy(F.desc("c"), "word").limit(OWN_CLASSES - 1).select("word").collect()]
    top = np.sort(np.array([int(END), *frequent], dtype=np.int64))
    # One row per frequent word and per shared class.
    cls = F.when(F.col("word").isin([int(w) for w in top]), F.col("word")).otherwise(F.lit(None).cast("long"))
    mass_rows = known.groupBy(cls.alias("word"), F.when(cls.isNull(), F.col("prefix")).alias("prefix")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    mass = np.zeros((CLASSES, 2))
    for r in mass_rows:
        at = int(np.searchsorted(top, r["word"])) if r["word"] is not None else OWN_CLASSES + r["prefix"]
        mass[at] = r["n"], r["v"]
    total, distinct = int(mass[:, 0].sum()), int(mass[:, 1].sum())
    counted = _dictionary(chunks).select("word", "slot").join(vocabulary.select("word", "c"), "word")
    model = spark.sparkContext.broadcast(train(chunks, top, rounds))
    log_mass = np.log10(mass.sum(axis=1) + 1)
    log_all = np.log10(total + distinct + 1)
    schema = T.StructType([T.StructField("doc_id", df.schema[id_column].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, held, sizes = (batch.column(i)[r].values for i in range(3))
                w, p, t, z = (batch.column(i)[r].as_py() for i in range(3, 7))
                own, token, n, c = _open(w, np.int64), _open(t, np.int32), sizes.to_numpy().astype(np.int64), _open(z, np.int64)
                cls = _classes(own, _open(p, np.uint8), top)
                history = _History(own, token, n)
                chance = np.empty(len(token))
                for s in range(0, len(token), BATCH):
                    part = _chance(*model.value, history.features(s, min(len(token), s + BATCH)))
                    chance[s:s + BATCH] = part[cls[token[s:s + BATCH]], np.arange(part.shape[1])]
                first = np.cumsum(n) - n
                log_c = np.add.reduceat(np.log10(c + 1.0)[token], first)
                inside = np.add.reduceat(np.log10(np.maximum(chance, 1e-30)) - log_mass[cls[token]], first)
                n_known = np.add.reduceat((c > 0)[token].astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(n), pa.array(n_known), pa.array(np.full(len(n), total)),
                                                  pa.array(log_c - n * log_all), pa.array(log_c + inside)], names=schema.names)

    rows = chunks.select("chunk", "doc_id", "held_out", "n", "words", "prefix", "tokens").join(_gathered(counted), "chunk")
    return rows.select("doc_id", "held_out", "n", "words", "prefix", "tokens", "c").mapInArrow(run, schema)
