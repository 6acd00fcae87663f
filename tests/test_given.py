from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import query_catalog
from evenfold.operators import given


def _file(rows) -> pa.RecordBatch:
    buffer = io.BytesIO()
    names = ("cohort_id", "id_a", "id_b", "dist")
    pq.write_table(pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)}), buffer)
    return pa.record_batch({"content": pa.array([buffer.getvalue()], pa.binary())})


def _tiles(rows, many, packed, monkeypatch):
    monkeypatch.setattr(given, "PACKED", packed)
    pieces = pa.Table.from_batches(given.pack(iter([_file(rows)]), many)).to_pylist()
    keys = sorted({(p["cohort_id"], p["_i"], p["_j"]) for p in pieces})
    return {k: given.tile(pa.Table.from_pylist([p for p in pieces if (p["cohort_id"], p["_i"], p["_j"]) == k])).to_pylist() for k in keys}


@pytest.mark.parametrize("packed", [7, 1 << 20])
@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("top", [50, 1 << 40])
def test_pieces_make_the_matrix(monkeypatch, packed, blocks, top):
    """Two cohorts in random order, pairs that come twice, ids with themselves, keys that are null."""
    rng = np.random.default_rng(packed + blocks)
    rows, matrices = [(None, 1, 2, 3), (1, None, None, 4)], {}
    for cohort, n in ((1, 23), (-4, 9)):
        d = rng.integers(0, top, (n, n))
        matrices[cohort] = d = np.triu(d, 1) + np.triu(d, 1).T
        pairs = [(cohort, 10 * i - 50, 10 * j - 50, int(d[i, j])) for i in range(n) for j in range(i, n)]
        rows += pairs + pairs[::5]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    found, pairs = [], {1: 0, -4: 0}
    for (cohort, *_), slices in _tiles(rows, {1: blocks} if blocks > 1 else {}, packed, monkeypatch).items():
        assert sum(s["bad"] for s in slices) == 0
        pairs[cohort] += sum(s["pairs"] for s in slices)
        found += slices
    assert pairs == {1: 23 * 22 // 2, -4: 9 * 8 // 2}
    own = {(s["cohort_id"], s["id"]): s["own"] for s in found}
    assert len(own) == 32
    for s in found:
        members = [k for k in range(len(matrices[s["cohort_id"]])) if own[s["cohort_id"], 10 * k - 50] == s["part"]]
        assert np.frombuffer(s["dist"], np.int64).tolist() == matrices[s["cohort_id"]][(s["id"] + 50) // 10, members].tolist()


@pytest.mark.parametrize("packed", [1, 1 << 20])
@pytest.mark.parametrize("extra", [(1, 0, 1, 6), (1, 0, 1, None), (1, 0, 1, -5), (1, 2, 2, 1), (1, 2, 2, None)])
def test_bad_pairs_are_counted_once(monkeypatch, packed, extra):
    rows = [(1, 0, 1, 5), (1, 0, 2, 5), (1, 1, 2, 5), extra, extra]
    (slices,) = _tiles(rows, {}, packed, monkeypatch).values()
    assert sum(s["bad"] for s in slices) == 1 and sum(s["pairs"] for s in slices) == 3
    assert all(s["dist"] is None for s in slices)


def test_pairs_are_made_in_all_tasks(spark, people):
    """People who come in one partition, as from one file, are paired in more than one task."""
    table = people([(i, "Male", 1.0 + i % 4, 1.0, 1.0, "Visual", "X") for i in range(50)]).coalesce(1)
    pairs = query_catalog._given(table)
    assert pairs.count() == 50 * 49 // 2 and pairs.rdd.getNumPartitions() > 1
