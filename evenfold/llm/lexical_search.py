"""Ranked lexical search, term at a time, with limited accumulators.

Documents are read once and become an index in chunks: the chunk's documents, and per term of the queries its
postings (document, occurrences). Statistics over all documents give every term its weight. Then every task goes
through its chunks and, for each query, through the query's terms from the rarest on. A term adds
its contributions to accumulators, one per document met. Before each term the bounds of all terms left are summed: once that
sum is below the k-th best partial score, no document without accumulator can reach the k best, so none is created any
more; accumulators that cannot get there either are dropped, and the others receive all further contributions, so their scores are exact. The k best of the
chunks a task has seen set its later thresholds, and k rows per query and task meet in the end.

Queries are taken in blocks of bounded size, as their terms are sent to all tasks. A block holds whole queries, so it exceeds
the bound only where one query alone does.

Rows with one item_id are one query with the terms of all of them; a null item_id is an id like any other.
Null and empty texts have no terms and are never found; rows with one doc_id are documents of their own, a null doc_id
orders last. Equal scores go by id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenfold.llm.tables import Workspace
from evenfold.llm.terms import term_lists

#: Bytes of query terms that one block of queries sends to every task.
BLOCK_BYTES = 16 << 20
#: A chunk of the index is full with so many documents or postings.
CHUNK_DOCS, CHUNK_POSTINGS = 1 << 14, 1 << 21


def item_terms(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """(item_id, term): the distinct terms of each query."""
    own = items.select(F.col(id_column).alias("item_id"), F.col(text).cast("binary").alias("text"))
    kind = own.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at, raw in enumerate(batch.column(1)):
                for found in term_lists(raw.as_py()):
                    if terms := sorted(set(found)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.concat_arrays([batch.column(0).slice(at, 1)] * len(terms)), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return own.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _blocks(asked: DataFrame, block_bytes: int) -> int:
    """How many blocks the queries are dealt to, so that none but a single large query exceeds the bound."""
    size = F.sum(F.octet_length("term") + 64).alias("bytes")
    items = asked.groupBy("item_id").agg(size)
    total, count = items.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-total // block_bytes))
    while 1 < n < 2 * count:
        shared = items.groupBy(_block(n).alias("b")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        if shared.where((F.col("n") > 1) & (F.col("bytes") > 2 * block_bytes)).isEmpty():
            break
        n *= 2
    return n


def _block(n: int):
    return F.pmod(F.xxhash64("item_id"), F.lit(n))


def _chunks(docs: DataFrame, id_column: str, text: str, vocabulary) -> DataFrame:
    """The index: per chunk its documents' ids and numbers of terms, and postings sorted by term.

    ``n_docs`` and ``n_terms`` count all documents with a term; those without a term of a query are counted and not kept.
    """
    own = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        number = vocabulary.value
        ids: list = []
        lengths: list[int] = []
        rows: list[np.ndarray] = []
        terms: list[np.ndarray] = []
        tfs: list[np.ndarray] = []
        n_docs = n_terms = postings = 0
        id_type = None

        def chunk() -> pa.RecordBatch:
            nonlocal n_docs, n_terms, postings
            row, term, tf = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in (rows, terms, tfs))
            order = np.argsort(term, kind="stable")
            known, starts = np.unique(term[order], return_index=True)
            starts = np.append(starts, len(term)).astype(np.int64)
            packed = [pa.array([a.tobytes()], pa.binary()) for a in (
                np.array(lengths, np.int64), known.astype(np.int32), starts, row[order].astype(np.int32), tf[order].astype(np.int32))]
            out = pa.RecordBatch.from_arrays(
                [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), pa.array([ids], pa.list_(id_type)), *packed],
                names=["n_docs", "n_terms", "ids", "lengths", "terms", "starts", "docs", "tfs"])
            n_docs = n_terms = postings = 0
            for part in (ids, lengths, rows, terms, tfs):
                part.clear()
            return out

        for batch in batches:
            id_type = batch.column(0).type
            for doc, raw in zip(batch.column(0), batch.column(1)):
                counts: Counter[bytes] = Counter()
                for found in term_lists(raw.as_py()):
                    counts.update(found)
                if not counts:
                    continue
                n = counts.total()
                n_docs += 1
                n_terms += n
                own_terms = {number[t]: c for t, c in counts.items() if t in number}
                if own_terms:
                    rows.append(np.full(len(own_terms), len(ids), np.int64))
                    terms.append(np.fromiter(own_terms.keys(), np.int64, len(own_terms)))
                    tfs.append(np.fromiter(own_terms.values(), np.int64, len(own_terms)))
                    ids.append(doc.as_py())
                    lengths.append(n)
                    postings += len(own_terms)
                if len(ids) >= CHUNK_DOCS or postings >= CHUNK_POSTINGS:
                    yield chunk()
        if n_docs:
            yield chunk()

    return own.mapInArrow(run, f"n_docs long, n_terms long, ids array<{kind.simpleString()}>, lengths binary, terms binary, "
                               "starts binary, docs binary, tfs binary")


def _statistics(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the documents per term: at most one row per term of the block reaches the driver."""
    def run(batches):
        found = np.zeros(size, np.int64)
        n = total = 0
        for batch in batches:
            for docs, terms, known, starts in zip(*(c.to_pylist() for c in batch.columns)):
                n, total = n + docs, total + terms
                found[np.frombuffer(known, np.int32)] += np.diff(np.frombuffer(starts, np.int64))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], held))), pa.array(np.concatenate(([n, total], found[held])))], names=["term", "n"])

    sums = index.select("n_docs", "n_terms", "terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = {r["term"]: r["n"] for r in sums.collect()}
    return known.get(-1, 0), known.get(-2, 0), np.array([known.get(t, 0) for t in range(size)], np.int64)


@dataclass(frozen=True)
class Scoring:
    """Weights and length norms from the statistics of all documents."""

    n: int
    total: int
    weight: np.ndarray

    @classmethod
    def fit(cls, n: int, total: int, df: np.ndarray) -> Scoring:
        return cls(n, total, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64))

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """100 - 50 + (50 * n * N) div L per document."""
        if int(lengths.max(initial=0)) * 50 * self.n < 1 << 62:
            return 50 + lengths * 50 * self.n // max(1, self.total)
        return np.array([50 + 50 * int(x) * self.n // self.total for x in lengths], np.int64)

    def impacts(self, tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 20 * norms)


class Chunk:
    """Postings of one chunk with their impacts, and the largest impact per term."""

    def __init__(self, lengths: bytes, terms: bytes, starts: bytes, docs: bytes, tfs: bytes, scoring: Scoring):
        self.starts, self.docs = np.frombuffer(starts, np.int64), np.frombuffer(docs, np.int32)
        self.place = {int(t): k for k, t in enumerate(np.frombuffer(terms, np.int32))}
        self.size = len(lengths) // 8
        norms = scoring.norms(np.frombuffer(lengths, np.int64))
        self.impacts = scoring.impacts(np.frombuffer(tfs, np.int32).astype(np.int64), norms[self.docs])
        self.largest = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(self.docs) else self.impacts
        self.weight = scoring.weight

    def best(self, order: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (and exact scores) that may be among the k best; all that reach ``threshold`` are there.

        ``order`` lists the query's terms, rarest first.
        """
        terms = [(int(self.weight[t]), self.place[t]) for t in order.tolist() if t in self.place]
        bounds = [w * int(self.largest[at]) for w, at in terms]
        left = sum(bounds)
        if left < max(threshold, 1):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score, met, creating = np.zeros(self.size, np.int64), np.zeros(self.size, bool), True
        for (w, at), bound in zip(terms, bounds):
            if creating:
                partial = score[met]
                kth = threshold
                if len(partial) >= k:
                    kth = max(kth, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
                if left < kth:
                    creating = False
                    met &= score + left >= kth
            docs = self.docs[self.starts[at]:self.starts[at + 1]]
            given = w * self.impacts[self.starts[at]:self.starts[at + 1]]
            if creating:
                met[docs] = True
                score[docs] += given
            else:
                alive = met[docs]
                score[docs[alive]] += given[alive]
            left -= bound
        found = np.flatnonzero(met & (score >= max(threshold, 1)))
        return found, score[found]


def _ranked(index: DataFrame, query, k: int, item_type: str, doc_type: str) -> DataFrame:
    """Each task's k best rows per query of the block."""
    def run(batches):
        item_ids, orders, scoring = query.value
        best: list[list[tuple[int, bool, object]]] = [[] for _ in orders]
        types = None
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            types = columns["ids"].type.value_type
            for at in range(batch.num_rows):
                chunk = Chunk(*(columns[c][at].as_py() for c in ("lengths", "terms", "starts", "docs", "tfs")), scoring)
                ids = columns["ids"][at].values
                for i, order in enumerate(orders):
                    docs, scores = chunk.best(order, k, -best[i][-1][0] if len(best[i]) == k else 0)
                    if len(docs) > k:  # ties with the k-th stay until ids decide
                        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        docs, scores = docs[near], scores[near]
                    if len(docs):
                        named = ids.take(pa.array(docs)).to_pylist()
                        best[i] = sorted([*best[i], *((-s, d is None, d) for s, d in zip(scores.tolist(), named))],
                                         key=lambda r: r if not r[1] else (r[0], True, 0))[:k]
        rows = [(item_ids[i], d, -s) for i, own in enumerate(best) for s, _, d in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], types),
                                              pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "starts", "docs", "tfs").mapInArrow(run, f"item long, doc_id {doc_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id",
           item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents for each query, scores above 0 only."""
    spark = docs.sparkSession
    work = Workspace(spark, "lexical")
    asked = work.write(item_terms(items, item_column, item_text), "asked")
    item_type, doc_type = asked.schema["item_id"].dataType.simpleString(), docs.schema[id_column].dataType.simpleString()
    n_blocks = _blocks(asked, block_bytes)
    found = []
    for b in range(n_blocks):
        # Bounded: a block of queries.
        own = asked.where(_block(n_blocks) == b).orderBy("item_id", "term").collect()
        number = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in own}))}
        by_item: dict[object, list[int]] = {}
        for r in own:
            by_item.setdefault(r["item_id"], []).append(number[bytes(r["term"])])
        vocabulary = spark.sparkContext.broadcast(number)
        index = work.write(_chunks(docs, id_column, text, vocabulary), f"index{b}")
        scoring = Scoring.fit(*_statistics(index, len(number)))
        orders = [np.array(sorted(terms, key=lambda t: (-scoring.weight[t], t)), np.int64) for terms in by_item.values()]
        query = spark.sparkContext.broadcast((list(range(len(orders))), orders, scoring))
        ranked = _ranked(index, query, k, item_type, doc_type)
        names = spark.createDataFrame(list(enumerate(by_item)), f"item long, item_id {item_type}")
        found.append(work.write(ranked.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"), f"ranked{b}"))
        work.drop(f"index{b}")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
