"""The isolation swaps of one cohort whose people are all known to the task.

People who may come are filed by trait, match and profile in order of (group, row). Groups untouched so far are read
from the sorted file; people of touched groups stand in heaps of their own and are checked when they come up. A turn looks
through the profiles in order of distance and stops behind the nearest that has somebody, so it costs about as
much as the profiles it passes and never looks through the people. Nothing is estimated: every turn is decided.

Rows that repeat a ``row_id`` move together, as labels are kept by ``row_id``.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Sent to executors whole, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TURN, PERSON, PROFILE = 0, 1, 2
PLACE = ("q_motivation", "q_esteem", "q_ethic")
SCHEMA = pa.schema([
    ("cohort_id", pa.int64()), ("turn", pa.int64()), ("group_id", pa.int32()), ("isolation_type", pa.string()),
    ("in_id", pa.int64()), ("donor_group", pa.int32()), ("out_id", pa.int64()), ("dist", pa.int64())])


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Numbers of the values, -1 for null, and the values."""
    found = pc.dictionary_encode(column.combine_chunks())
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return pc.fill_null(found.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def _whole(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


class Cohort:
    """Who is where, and who may come."""

    def __init__(self, table: pa.Table, by_gender: bool, strict_donor: bool, keeps: int):
        self.by_gender, self.strict, self.keeps = by_gender, strict_donor, keeps
        kind = table.column("kind").to_numpy()
        trait, self.names = _codes(table.column("trait"))
        match, _ = _codes(table.column("match"))
        known = (kind == PERSON) & (trait >= 0)
        shapes, people = table.filter(pa.array(kind == PROFILE)), table.filter(pa.array(known))
        ids = _whole(shapes, "profile_id")
        order = np.argsort(ids, kind="stable")
        self.place = np.stack([_whole(shapes, c)[order] for c in PLACE], axis=1)
        self.gap, self.style = _whole(shapes, "q_gap")[order], _codes(shapes.column("Learning_Style"))[0][order]
        self.profile = np.searchsorted(ids[order], _whole(people, "profile_id"))
        self.row, self.home = _whole(people, "row_id"), _whole(people, "group_id")
        self.trait, self.match = trait[known], match[known]
        self.traits, self.matches, self.profiles = len(self.names), int(match.max(initial=0)) + 1, len(ids)
        self.moved: dict[int, int] = {}
        self.members: dict[int, set[int]] = {}
        self.touched: set[int] = set()
        self.near: dict[int, tuple[list[int], list[int]]] = {}
        self.by_home = np.argsort(self.home, kind="stable")
        self.homes = self.home[self.by_home]
        self.kinds, at, self.counts = np.unique(self.home * self.traits + self.trait, return_inverse=True, return_counts=True)
        self.held: dict[int, int] = {}
        rows, often = np.unique(self.row, return_counts=True)
        self.copies: dict[int, list[int]] = {}
        if len(rows) < len(self.row):
            for i in np.flatnonzero(np.isin(self.row, rows[often > 1])).tolist():
                self.copies.setdefault(int(self.row[i]), []).append(i)
        self._file(self.counts[at])

    def other(self, wanted: int) -> int:
        """The gender given in exchange for ``wanted``; -1 if nobody is of it."""
        name = "Male" if self.names[wanted] == "Female" else "Female"
        return self.names.index(name) if name in self.names else -1

    def _file(self, held: np.ndarray) -> None:
        spare = held > self.keeps
        if not self.by_gender:
            spare |= held == 1
        elif self.strict:
            opposite = np.array([self.other(t) for t in range(self.traits)], np.int64)[self.trait]
            spare &= (opposite >= 0) & np.isin(self.home * self.traits + opposite, self.kinds)
        who = np.flatnonzero(spare & (self.match >= 0))
        key = self.key(self.trait[who], self.match[who], self.profile[who])
        order = np.lexsort((self.row[who], self.home[who], key))
        self.filed = who[order]
        keys, starts = np.unique(key[order], return_index=True)
        self.spans = {k: [a, b] for k, a, b in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(who)])}
        self.heaps: dict[int, list[tuple[int, int, int]]] = {}

    def key(self, trait, match, profile):
        return (trait * self.matches + match) * self.profiles + profile

    def count(self, group: int, trait: int) -> int:
        kind = group * self.traits + trait
        if kind not in self.held:
            at = int(np.searchsorted(self.kinds, kind))
            self.held[kind] = int(self.counts[at]) if at < len(self.kinds) and self.kinds[at] == kind else 0
        return self.held[kind]

    def inside(self, group: int) -> set[int]:
        if group not in self.members:
            first, last = np.searchsorted(self.homes, [group, group + 1])
            self.members[group] = set(self.by_home[first:last].tolist())
        return self.members[group]

    def can_spare(self, group: int, trait: int) -> bool:
        held = self.count(group, trait)
        if not self.by_gender:
            return held > self.keeps or held == 1
        if held <= self.keeps or not self.strict:
            return held > self.keeps
        other = self.other(trait)
        return other >= 0 and self.count(group, other) >= 1

    def leaving(self, group: int, wanted: int, given: int) -> dict[tuple[int, int], int]:
        """The first person of each kind (match and profile) who may leave the group."""
        first: dict[tuple[int, int], int] = {}
        for i in self.inside(group):
            trait = int(self.trait[i])
            if self.by_gender:
                free = trait == given
            else:
                held = self.count(group, trait)
                free = trait != wanted and (held > self.keeps or held == 1)
            if free and self.match[i] >= 0:
                kind = (int(self.match[i]), int(self.profile[i]))
                if kind not in first or self.row[i] < self.row[first[kind]]:
                    first[kind] = i
        return first

    def first(self, key: int, group: int, wanted: int) -> tuple[int, int, int] | None:
        """The least (donor group, row, person) of a kind who can come into ``group``."""
        best = None
        if span := self.spans.get(key):
            at, end = span
            while at < end and int(self.home[self.filed[at]]) in self.touched:
                at += 1
            span[0] = at
            while at < end and ((home := int(self.home[self.filed[at]])) == group or home in self.touched):
                at += 1
            if at < end:
                best = (home, int(self.row[self.filed[at]]), int(self.filed[at]))
        if heap := self.heaps.get(key):
            aside = []
            while heap:
                donor, _, who = heap[0]
                if self.moved.get(who, donor) != donor or not self.can_spare(donor, wanted):
                    heapq.heappop(heap)
                elif donor == group:
                    aside.append(heapq.heappop(heap))
                else:
                    break
            if heap and (best is None or heap[0] < best):
                best = heap[0]
            for own in set(aside):
                heapq.heappush(heap, own)
        return best

    def nearest(self, profile: int) -> tuple[list[int], list[int]]:
        """All profiles in order of distance, and the distances."""
        if profile not in self.near:
            dist = np.abs(self.place - self.place[profile]).sum(axis=1)
            dist += np.where(self.style != self.style[profile], self.gap + self.gap[profile], 0)
            order = np.argsort(dist, kind="stable")
            self.near[profile] = order.tolist(), dist[order].tolist()
        return self.near[profile]

    def best(self, group: int, wanted: int, given: int) -> tuple[int, int, int, int, int, int] | None:
        """The least (distance, donor group, row that comes, row that goes), with both people."""
        found = None
        for (match, profile), went in self.leaving(group, wanted, given).items():
            for q, dist in zip(*self.nearest(profile)):
                if found and dist > found[0]:
                    break
                if came := self.first(self.key(wanted, match, q), group, wanted):
                    swap = (dist, came[0], came[1], int(self.row[went]), came[2], went)
                    found = swap if found is None else min(found, swap)
        return found

    def swap(self, group: int, donor: int, came: int, went: int) -> None:
        changed = {group, donor}
        for person, to in ((came, group), (went, donor)):
            for i in self.copies.get(int(self.row[person]), [person]):
                old, trait = self.moved.get(i, int(self.home[i])), int(self.trait[i])
                self.inside(old).discard(i)
                self.inside(to).add(i)
                self.moved[i] = to
                for place, step in ((old, -1), (to, 1)):
                    self.held[place * self.traits + trait] = self.count(place, trait) + step
                changed.add(old)
        self.touched |= changed
        for place in changed:
            for i in self.inside(place):
                trait = int(self.trait[i])
                if self.match[i] >= 0 and self.can_spare(place, trait):
                    key = self.key(trait, int(self.match[i]), int(self.profile[i]))
                    heapq.heappush(self.heaps.setdefault(key, []), (place, int(self.row[i]), i))


def whole_turns(table: pa.Table, by_gender: bool, strict_donor: bool, keeps: int) -> pa.Table:
    """All due turns of a cohort in order; a turn without a possible swap has no ids.

    The table holds rows of three ``kind``s: the due turns, all people, and the profiles.
    """
    cohort = Cohort(table, by_gender, strict_donor, keeps)
    codes = {name: code for code, name in enumerate(cohort.names)}
    due = table.filter(pc.equal(table.column("kind"), TURN)).sort_by("turn")
    out = []
    for step in due.select(["cohort_id", "turn", "group_id", "isolation_type", "trait", "given"]).to_pylist():
        group = step["group_id"]
        found = cohort.best(group, codes[step["trait"]], codes.get(step["given"], -1))
        dist, donor, came, went = found[:4] if found else (None, None, None, None)
        if found:
            cohort.swap(group, donor, found[4], found[5])
        out.append({"cohort_id": step["cohort_id"], "turn": step["turn"], "group_id": group, "isolation_type": step["isolation_type"],
                    "in_id": came, "donor_group": donor, "out_id": went, "dist": dist})
    return pa.Table.from_pylist(out, schema=SCHEMA)
