"""Summed distances between a block of profiles and a block of groups, as matrices.

Profiles known by columns are compared profile by profile and the rows of equal profiles are shared by all their cells;
vectors are compared by products of matrices, and pairs so near that the product would lose digits again by
their differences.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Sent to executors whole, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REACH = "run string, cohort_id bigint, profile_id bigint, group_id bigint, total double, cut boolean"
VECTOR = "vector"
#: Distances held at once.
CELLS = 1 << 20
#: Squared distances under this share of the squared lengths are computed from differences.
NEAR = 1e-4

#: Points and cells whose vectors are compared at once, so that their distances stay in the processor's cache.
POINTS, COLUMNS = 256, 1_024

Between = Callable[[slice], np.ndarray]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    found = pc.dictionary_encode(column.combine_chunks())
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return pc.fill_null(found.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)


def _measured(table: pa.Table, metric: str, a: np.ndarray, b: np.ndarray) -> Between:
    """Distances of the rows ``a[part]`` to the rows ``b`` from the columns of a metric, terms in the order of the columns."""
    def number(name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(np.float64)

    if metric == "euclidean":
        scores = [number(c) for c in ("z_motivation", "z_esteem", "z_ethic")]
        style, squares = _codes(table.column("Learning_Style")), number("z_gap") ** 2

        def between(part: slice) -> np.ndarray:
            total = np.zeros((len(a[part]), len(b)))
            for x in scores:
                total += (x[a[part], None] - x[None, b]) ** 2
            total += np.where(style[a[part], None] == style[None, b], 0.0, squares[a[part], None] + squares[None, b])
            return np.sqrt(total)
        return between
    scores = [(number(c), number(f"span_{short}")) for c, short in (("Motivation", "motivation"), ("Self_Esteem", "esteem"), ("Work_Ethic", "ethic"))]
    kinds = [_codes(table.column(c)) for c in ("Gender", "Diversity", "Learning_Style")]

    def between(part: slice) -> np.ndarray:
        total = np.zeros((len(a[part]), len(b)))
        for x, span in scores:
            width = span[a[part], None]
            total += np.where(width == 0, 0.0, np.abs(x[a[part], None] - x[None, b]) / np.where(width == 0, 1.0, width))
        for x in kinds:
            total += x[a[part], None] != x[None, b]
        return total / 6
    return between


def _vectors(table: pa.Table, a: np.ndarray, b: np.ndarray) -> Callable[[slice, slice], np.ndarray]:
    """Distances of the rows ``a[part]`` to the rows ``b[cols]`` from their vectors."""
    vectors = table.column("features").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    matrix = vectors.flatten().to_numpy().reshape(len(vectors), -1)
    left, right = matrix[a], matrix[b]
    # Near the middle of the block products lose less.
    middle = matrix.mean(axis=0)
    moved, others = left - middle, right - middle
    lengths, lengths_b = (moved * moved).sum(axis=1), (others * others).sum(axis=1)
    # One product gives the whole square: both lengths and twice the inner product.
    ones = np.ones((len(table), 1))
    moved, others = np.hstack([moved, lengths[:, None], ones[:len(a)]]), np.hstack([-2 * others, ones[:len(b)], lengths_b[:, None]])

    def between(part: slice, cols: slice = slice(None)) -> np.ndarray:
        lines, across = lengths[part, None], lengths_b[None, cols]
        squares = moved[part] @ others[cols].T
        # ``not larger`` also takes what overflowed. Only lines whose least square is small can have something near.
        few = np.flatnonzero(~(squares.min(axis=1) > NEAR * (lines[:, 0] + across.max())))
        i, j = np.nonzero(~(squares[few] > NEAR * (lines[few] + across)))
        i = few[i]
        for k in range(0, len(i), CELLS // 64):
            gap = left[part][i[k:k + CELLS // 64]] - right[cols][j[k:k + CELLS // 64]]
            squares[i[k:k + CELLS // 64], j[k:k + CELLS // 64]] = (gap * gap).sum(axis=1)
        return np.sqrt(squares, out=squares)
    return between


def _sums(between: Callable[[slice, slice], np.ndarray], weight: np.ndarray, first: np.ndarray, group_of: np.ndarray) -> Between:
    """Summed distances of the rows of a part to each group, tile by tile of ``COLUMNS`` cells, which stand group by group."""
    n, alike = len(weight), bool((weight == 1).all())
    tiles = [(slice(k, min(k + COLUMNS, n)), int(group_of[k]), np.concatenate([[0], first[(first > k) & (first < k + COLUMNS)] - k])) for k in range(0, n, COLUMNS)]

    def totals(part: slice) -> np.ndarray:
        out: np.ndarray | None = None
        for cols, group, starts in tiles:
            far = between(part, cols)
            if not alike:
                far *= weight[cols]
            if out is None:
                out = np.zeros((len(far), len(first)))
            out[:, group:group + len(starts)] += np.add.reduceat(far, starts, axis=1)
        return out
    return totals


def block_reach(table: pa.Table, metric: str) -> pa.Table:
    """Sums of one block: for whole groups the two nearest of each profile and its own, for cut groups all.

    Rows without a group are the profiles that ask, the others are cells.
    """
    asks = table.column("group_id").is_null().to_numpy()
    ids, people = table.column("profile_id").to_numpy(), pc.fill_null(table.column("people"), 0).to_numpy()
    groups, sizes = pc.fill_null(table.column("group_id"), 0).to_numpy(), pc.fill_null(table.column("size"), 0).to_numpy()
    cuts = table.column("cut").to_numpy()
    points, cells = np.flatnonzero(asks), np.flatnonzero(~asks)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    if len(points) and len(cells):
        cells = cells[np.lexsort((ids[cells], groups[cells]))]
        names, first = np.unique(groups[cells], return_index=True)
        weight, size, cut = people[cells].astype(np.float64), sizes[cells][first].astype(np.float64), cuts[cells][first]
        # Cells of one profile share its distances.
        known, one, at = np.unique(ids[cells], return_index=True, return_inverse=True)
        distinct = cells[one]
        group_of = np.repeat(np.arange(len(names)), np.diff([*first, len(cells)]))
        if tiled := metric == VECTOR and len(known) == len(cells):
            sums = _sums(_vectors(table, points, cells), weight, first, group_of)
        else:
            between = _vectors(table, points, distinct) if metric == VECTOR else _measured(table, metric, points, distinct)
        kept = np.flatnonzero(~cut)
        places = np.searchsorted(known, ids[points]).clip(max=len(known) - 1)
        where = np.where(known[places] == ids[points], places, -1)
        by_profile = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[by_profile], np.arange(len(known) + 1))
        step = min(POINTS, max(1, CELLS // len(names))) if tiled else max(1, CELLS // max(len(cells), 1))
        for s in range(0, len(points), step):
            part = slice(s, min(s + step, len(points)))
            totals = sums(part) if tiled else np.add.reduceat(between(part)[:, at] * weight, first, axis=1)
            line = np.arange(len(totals))
            wanted = np.zeros(totals.shape, bool)
            wanted[:, cut] = True
            if len(kept):
                means = totals[:, kept] / size[kept]
                for _ in range(min(2, len(kept))):  # groups stand in ascending order, so a tie goes to the lowest
                    least = means.argmin(axis=1)
                    wanted[line, kept[least]] = True
                    means[line, least] = np.inf
            for k in np.flatnonzero(where[part] >= 0):
                p = where[part][k]
                wanted[k, group_of[by_profile[starts[p]:starts[p + 1]]]] = True
            i, j = np.nonzero(wanted)
            out.append((ids[points[part]][i], names[j], totals[i, j], cut[j]))
    profile, group, total, cut = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, bool))
    run, cohort = table.column("run")[0].as_py(), table.column("cohort_id")[0].as_py()
    return pa.table({
        "run": pa.array([run] * len(profile), pa.string()), "cohort_id": pa.array([cohort] * len(profile), pa.int64()),
        "profile_id": pa.array(profile, pa.int64()), "group_id": pa.array(group, pa.int64()),
        "total": pa.array(total, pa.float64()), "cut": pa.array(cut, pa.bool_())})
