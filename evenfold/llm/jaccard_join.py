"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams, each a 64-bit hash. A parity sketch hashes every
member to one bit of one of K words and flips it. Two sketches differ in no more bits than
the sets differ in members, so two sets within a difference D differ in at most D words of the sketch:
of K = D + 1 + G words at least G + 1 agree. A set therefore files only its D + 1 words with the
most bits (ties to the lower place): what two sets agree on is ranked alike in both, so the
strongest word on which they agree is filed by both. The K words share 2**48 bits and are held as the
XOR of their bits' hashes, so that sets without a common member have hardly a word in common, however
many sets there are. Sizes fall in bands; a set files words for its own band and for the one below, where
it can be the larger partner.

Sets that share a filed word are candidates. A second, compact sketch (a power of two of words, so that
sizes differ by folding) travels with each set; its Hamming distance rejects most candidates, and the sets
themselves decide about the rest. Links only matter up to reachability, so a bucket is first joined as a
star around its least member. A bucket of three or more whose members are then still of different
components is compared pair by pair inside tasks, in blocks: first only a spanning forest of the likely
pairs leaves the task, then, after these have been decided, every likely pair that is still open.

Sets are told apart by a 64-bit hash: with a billion different texts the chance that any two
are confused is about 3 percent. Null ids, repeated rows and equal texts are nodes of one set.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.llm.components import components
from evenfold.llm.spans import SpanHash, mix, pieces, utf8, words
from evenfold.llm.tables import Workspace

BLOCK = 1024


@dataclass(frozen=True)
class Likeness:
    """Sets link when ``den * |A and B| >= num * |A or B|``; members are runs of ``width`` words."""

    width: int = 4
    num: int = 85
    den: int = 100

    def bands(self, largest: int) -> list[int]:
        """First sizes of the bands; a linked partner is in the same band or a neighbouring one."""
        found = [1]
        while found[-1] <= largest:
            found.append(max(found[-1] + 1, -(-found[-1] * self.den // self.num)))
        return [*found, max(found[-1] + 1, -(-found[-1] * self.den // self.num))]

    def difference(self, smaller: int) -> int:
        """Most members in which a set of this size and a larger linked one can differ."""
        return (self.den - self.num) * smaller // self.num

    def links(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


_U = np.uint64
_BANDS: dict[tuple, np.ndarray] = {}


def _bands(like: Likeness) -> np.ndarray:
    key = (like.num, like.den)
    if key not in _BANDS:
        _BANDS[key] = np.array(like.bands(1 << 40))
    return _BANDS[key]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each row; short rows are one n-gram."""
    starts, ends, rows = words(buf, offs)
    h = SpanHash(buf, seed=3, lower=True)(starts, ends)
    n = len(h) - width + 1
    grams = np.zeros(max(0, n), dtype=_U)
    for k in range(width if n > 0 else 0):
        grams = mix(grams * _U(0x9E3779B97F4A7C15) + h[k:k + n])
    found = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= width:
            found.append(np.unique(grams[a:b - width + 1]))
        else:
            one = np.array([b - a], dtype=_U)
            for k in range(a, b):
                one = mix(one * _U(0xA0761D6478BD642F) + h[k:k + 1])
            found.append(one[:b - a])
    return found


def node_of(members: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = mix(members ^ _U(0x5851F42D4C957F2D)).sum(keepdims=True) + np.array([len(members)], dtype=_U)
    return int(mix(total).view(np.int64)[0])


def sketch(members: np.ndarray, k: int) -> np.ndarray:
    """k words of parity bits. Members are sorted, so the words they fall in are, too."""
    word = ((members >> _U(32)) * _U(k)) >> _U(32)
    bit = _U(1) << (members & _U(63))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out = np.zeros(k, dtype=_U)
    out[word[first].astype(np.int64)] = np.bitwise_xor.reduceat(bit, first)
    return out


def wide_sketch(members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The XOR of the hashes of the odd bits, and their number, of each of k words that share 2**48 bits."""
    bits = members >> _U(16)  # members are sorted, so bits and the words they fall in are, too
    heads = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1])))
    bits = bits[heads][np.diff(heads, append=len(members)) & 1 == 1]
    value, count = np.zeros(k, dtype=_U), np.zeros(k, dtype=np.int64)
    if len(bits):
        word = (((bits >> _U(16)) * _U(k)) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        value[word[first]] = np.bitwise_xor.reduceat(mix(bits ^ _U(0x2545F4914F6CDD1D)), first)
        count[word[first]] = np.diff(first, append=len(bits))
    return value, count


def filed_keys(members: np.ndarray, like: Likeness) -> np.ndarray:
    """The bucket keys of a set: strongest sketch words for its band and the band below."""
    bands = _bands(like)
    own = int(np.searchsorted(bands, len(members), side="right")) - 1
    keys = []
    for band in (own, own - 1):
        if band < 0:
            continue
        most = like.difference(int(bands[band + 1]) - 1)
        if not most:
            continue  # only equal sets link, and those are one node
        spare = (most + 2) // 3
        value, count = wide_sketch(members, most + 1 + spare)
        strong = np.argsort(-count, kind="stable")[:most + 1]
        keys.append(mix(mix(value[strong]) + (strong.astype(_U) + _U((band + 1) << 40)) * _U(0xD1342543DE82EF95)))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=_U)


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = utf8(batch.column(batch.schema.get_field_index(text)))
    for a, b in pieces(offs):
        yield a, b, buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]


def with_sets(df: DataFrame, id_column: str, text: str, like: Likeness) -> DataFrame:
    """Per row: id, n_shingles and the set's name (null without words)."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_column].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())])

    def run(batches):
        for batch in batches:
            for a, b, buf, offs in _texts(batch, text):
                sets = shingle_sets(buf, offs, like.width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], names=schema.names)

    return df.select(id_column, text).mapInArrow(run, schema)


def _filed(df: DataFrame, text: str, like: Likeness) -> DataFrame:
    """(key, node); a set that a task has met before is not filed again."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, buf, offs in _texts(batch, text):
                keys, nodes = [], []
                for s in shingle_sets(buf, offs, like.width):
                    node = node_of(s) if len(s) else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    keys.append(filed_keys(s, like))
                    nodes.append(np.full(len(keys[-1]), node, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return df.select(text).mapInArrow(run, "key long, node long")


def compact(members: np.ndarray) -> np.ndarray:
    """A sketch whose words are a power of two, so that there are one to two bits for each member."""
    return sketch(members, 1 << max(4, int(len(members) >> 6).bit_length()))


def folded(s: np.ndarray, k: int) -> np.ndarray:
    """The sketch of k words that the same members would have."""
    while s.shape[-1] > k:
        s = s[..., 0::2] ^ s[..., 1::2]
    return s


def _once(df: DataFrame, text: str, like: Likeness, schema: str, row) -> DataFrame:
    """One row per set and task: its name and ``row(members, text bytes)``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, buf, offs in _texts(batch, text):
                raw, nodes, rest = buf.tobytes(), [], []
                for s, a, b in zip(shingle_sets(buf, offs, like.width), offs[:-1].tolist(), offs[1:].tolist()):
                    node = node_of(s) if len(s) else None
                    if node is not None and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        rest.append(row(s, raw[a:b]))
                columns = [pa.array([r[i] for r in rest], pa.binary() if i else pa.int64()) for i in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *columns], names=names)

    return df.select(text).mapInArrow(run, schema)


def _sketched(df: DataFrame, text: str, like: Likeness) -> DataFrame:
    return _once(df, text, like, "node long, n long, sk binary", lambda s, raw: (len(s), compact(s).tobytes()))


def _packed(df: DataFrame, text: str, like: Likeness) -> DataFrame:
    return _once(df, text, like, "node long, n long, z binary", lambda s, raw: (len(s), zstandard.compress(raw, 1)))


class _Sets:
    """Sets of packed texts, the last few kept."""

    def __init__(self, like: Likeness, kept: int = 600):
        self.like, self.kept, self.open = like, kept, zstandard.ZstdDecompressor()
        self.known: OrderedDict[int, np.ndarray] = OrderedDict()

    def __call__(self, node: int, z: bytes) -> np.ndarray:
        found = self.known.get(node)
        if found is None:
            raw = np.frombuffer(self.open.decompress(z), dtype=np.uint8)
            found = self.known[node] = shingle_sets(raw, np.array([0, len(raw)]), self.like.width)[0]
            if len(self.known) > self.kept:
                self.known.popitem(last=False)
        else:
            self.known.move_to_end(node)
        return found


def _stars(filed: DataFrame) -> DataFrame:
    """(key, leader, node) for the members of every bucket of two sets or more, streamed in key order."""
    def run(batches):
        key = leader = last = None
        told = False
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same, twin = np.empty(len(k), bool), np.empty(len(k), bool)
            same[0] = key is not None and k[0] == key
            twin[0] = same[0] and v[0] == last
            same[1:] = k[1:] == k[:-1]
            twin[1:] = same[1:] & (v[1:] == v[:-1])
            k, v, same = k[~twin], v[~twin], same[~twin]
            if not len(k):
                continue
            group = np.cumsum(~same)
            heads = np.flatnonzero(~same)
            leaders = np.concatenate(([leader if leader is not None else 0], v[heads]))[group]
            follows = np.flatnonzero(same)
            firsts = follows[np.concatenate(([True], group[follows[1:]] != group[follows[:-1]]))] if len(follows) else follows
            if told and len(firsts) and group[firsts[0]] == 0:
                firsts = firsts[1:]
            carried = len(heads) == 0
            told = bool(len(follows) and group[follows[-1]] == group[-1]) or (carried and told)
            key, leader, last = k[-1], leaders[-1], v[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((k[follows], k[firsts]))), pa.array(np.concatenate((leaders[follows], leaders[firsts]))),
                                              pa.array(np.concatenate((v[follows], leaders[firsts])))], names=["key", "leader", "node"])

    return filed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, leader long, node long")


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the column and size of either side."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col(column).alias(f"{column}{side}")), side)
    return pairs.select("a", "b", "na", "nb", f"{column}a", f"{column}b")


def _likely(pairs: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that sizes and sketches cannot rule out."""
    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = like.num * np.maximum(na, nb) <= like.den * np.minimum(na, nb)
            sa, sb = batch.column(4), batch.column(5)
            for i in np.flatnonzero(keep).tolist():
                x, y = np.frombuffer(sa[i].as_py(), _U), np.frombuffer(sb[i].as_py(), _U)
                k = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, k) ^ folded(y, k)).sum())
                keep[i] = apart * (like.den + like.num) <= (like.den - like.num) * int(na[i] + nb[i])
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return _both(pairs, sketches, "sk").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, packed: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    def run(batches):
        sets = _Sets(like, 64)
        for batch in batches:
            a, b, _, _, za, zb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                x, y = sets(a[i], za[i]), sets(b[i], zb[i])
                keep.append(like.links(len(x) + len(y) - len(np.union1d(x, y)), len(x), len(y)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return _both(pairs, packed, "z").mapInArrow(run, "a long, b long")


def _within(group: pa.Table, like: Likeness, forest: bool) -> pa.Table:
    """Likely pairs of different components among the sets of a block pair of one bucket; a spanning forest or all."""
    node, size = group.column("node").to_numpy(), group.column("n").to_numpy()
    sketches = [np.frombuffer(x, _U) for x in group.column("sk").to_pylist()]
    k = min(map(len, sketches))
    marks = np.stack([folded(x, k) for x in sketches])
    _, root = np.unique(group.column("comp").to_numpy(), return_inverse=True)
    a, b = [], []
    for p in range(len(node) - 1):
        others = np.flatnonzero(root[p + 1:] != root[p]) + p + 1
        if not len(others):
            continue
        apart = np.bitwise_count(marks[others] ^ marks[p]).sum(axis=1)
        near = others[(apart * (like.den + like.num) <= (like.den - like.num) * (size[others] + size[p]))
                      & (like.num * np.maximum(size[others], size[p]) <= like.den * np.minimum(size[others], size[p]))]
        for q in near.tolist():
            if forest and root[q] == root[p]:
                continue
            a.append(min(node[p], node[q]))
            b.append(max(node[p], node[q]))
            if forest:
                root[root == root[q]] = root[p]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open_pairs(stars: DataFrame, comp: DataFrame, sketches: DataFrame, like: Likeness, block: int, forest: bool) -> DataFrame:
    """Likely pairs in the buckets of three or more that span components."""
    named = stars.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    # Buckets with the same members are one bucket.
    buckets = named.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("sig"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("sig2")).where("lo != hi AND size > 2")
    buckets = buckets.groupBy("size", "sig", "sig2").agg(F.min("key").alias("key")).select("key", "size")
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = named.join(buckets, "key").withColumn("_i", F.pmod(F.xxhash64("node"), blocks).cast("int")).join(sketches, "node")
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "node", "comp", "n", "sk")
    return rows.groupBy("key", "i", "j").applyInArrow(lambda g: _within(g, like, forest), "a long, b long").distinct()


def jaccard_join(df: DataFrame, id_column: str = "doc_id", text: str = "text", like: Likeness = Likeness(), block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links), and the names of its set and component."""
    work = Workspace(df.sparkSession, "jaccard")
    docs = work.write(with_sets(df, id_column, text, like), "docs")
    stars = work.write(_stars(_filed(df, text, like)), "stars")
    members = work.write(stars.select("node").distinct(), "members")

    def of_members(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        return rows.join(wanted, "node", "left_semi").dropDuplicates(["node"])

    sketches = work.write(of_members(_sketched(df, text, like), members), "sketches")
    pairs = stars.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    tried = work.write(_likely(pairs, sketches, like), "tried0")
    ends = tried.select(F.explode(F.array("a", "b")).alias("node"))
    many = stars.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("key")
    ends = ends.unionByName(stars.join(many, "key", "left_semi").select("node")).distinct()
    packed = work.write(of_members(_packed(df, text, like), ends), "packed")
    links = work.write(_linked(tried, packed, like), "links0")
    comp = components(links, work, "comp0")
    for at, forest in ((1, True), (2, False)):
        more = _open_pairs(stars, comp, sketches, like, block, forest).join(tried, ["a", "b"], "left_anti")
        more = work.write(more, f"tried{at}")
        if more.isEmpty():
            continue  # a forest without untried pairs says nothing about the other pairs of its buckets
        tried = tried.unionByName(more)
        found = work.write(_linked(more, packed, like), f"links{at}")
        if not found.isEmpty():
            links = links.unionByName(found)
            comp = components(links, work, f"comp{at}")

    least = docs.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(comp, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    ids = rooted.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = work.write(rooted.join(ids, "comp").select("node", "comp", "component_id"), "named")
    return docs.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "comp")


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_node(df: DataFrame, like: Likeness, id_column: str, text: str, name: str) -> DataFrame:
    """Rows with words and, as ``name``, their set; later copies of a set in a task only if their id is smaller (null last)."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        least: dict[int, tuple] = {}
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_column)).to_pylist()
            for a, b, buf, offs in _texts(batch, text):
                rows, nodes = [], []
                for i, s in enumerate(shingle_sets(buf, offs, like.width), start=a):
                    if len(s):
                        node, rank = node_of(s), (ids[i] is None, ids[i])
                        if node not in least or (rank[0], rank[1] or 0) < (least[node][0], least[node][1] or 0):
                            least[node] = rank
                            rows.append(i)
                            nodes.append(node)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(nodes, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def keep_one(df: DataFrame, like: Likeness, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of linked rows, that of the least id (null last); rows without words all stay.

    Ids are whole numbers. The table may have columns of any other names. Copies of a set leave a task only once or
    with smaller ids, so a set with a third of all rows is met a few times per task.
    """
    joined = jaccard_join(df, id_column, text, like).where("node IS NOT NULL")
    first = joined.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "node")).alias("w"))
    node, wanted = unused(df, "_node"), unused(df, "_id")
    winners = first.select(F.col("w.node").alias(node), F.col("w.doc_id").alias(wanted))
    # A merge join deals texts by set, which is what dropDuplicates needs, too: they are shuffled once.
    named = with_node(df, like, id_column, text, node)
    kept = named.join(winners.hint("merge"), node).where(F.col(f"`{id_column}`").eqNullSafe(F.col(wanted))).dropDuplicates([node])
    wordless = df.where(~F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.select(*[f"`{c}`" for c in df.columns]).unionByName(wordless)
