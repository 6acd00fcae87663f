"""Several turns of the isolation swaps of one cohort, each on the labels the one before left.

A batch of flagged groups comes with two things: for every person who may leave, the nearest donor groups in order
(on the labels at the start of the batch), and the people of all groups named there. A list entry stays right
as long as its donor is untouched; groups touched by earlier turns are searched anew among their present
people. What no list shows is worse than the list's last entry. So the best swap of a turn is known, or the
batch ends before it and the turn opens the next batch, with fresh lists. The first turn of a batch is always known.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Sent to executors whole, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ["cohort_id", "turn", "group_id", "isolation_type", "in_id", "donor_group", "out_id", "dist"]
Held = dict[tuple[int, str], int]


class Cohort:
    """People of the known groups, who moves with every swap."""

    def __init__(self, people: pd.DataFrame):
        self.row = people["row_id"].to_numpy(np.int64)
        self.group = people["group_id"].to_numpy(np.int64).copy()
        self.trait, self.match = people["trait"].tolist(), people["match"].tolist()
        self.profile = people["profile_id"].tolist()
        self.place = people[["q_motivation", "q_esteem", "q_ethic"]].to_numpy(np.int64)
        self.gap = people["q_gap"].to_numpy(np.int64)
        self.style = pd.factorize(people["Learning_Style"], use_na_sentinel=False)[0]
        self.held: Held = dict(zip(zip(self.group.tolist(), self.trait), people["held"].tolist()))
        self.members: dict[int, set[int]] = defaultdict(set)
        for at, g in enumerate(self.group.tolist()):
            self.members[g].add(at)
        self.at = {r: at for at, r in enumerate(self.row.tolist())}
        self.touched: set[int] = set()

    def count(self, group: int, trait: str) -> int:
        return self.held.get((group, trait), 0)

    def leaving(self, group: int, may_go: Callable[[str, int], bool]) -> list[int]:
        """The first person of each kind who may leave the group."""
        first: dict[tuple, int] = {}
        for at in self.members[group]:
            if self.match[at] is not None and may_go(self.trait[at], self.count(group, self.trait[at])):
                kind = (self.match[at], self.profile[at])
                if kind not in first or self.row[at] < self.row[first[kind]]:
                    first[kind] = at
        return list(first.values())

    def nearest_touched(self, group: int, wanted: str, can_spare: Callable[[int], bool], outs: list[int]) -> tuple | None:
        """The best swap with a group that earlier turns touched."""
        pool = [at for g in self.touched if g != group and can_spare(g) for at in self.members[g]
                if self.trait[at] == wanted and self.match[at] is not None]
        if not pool:
            return None
        came, went = np.array(pool), np.array(outs)
        dist = np.abs(self.place[came, None, :] - self.place[None, went, :]).sum(axis=2)
        dist += np.where(self.style[came, None] != self.style[None, went], self.gap[came, None] + self.gap[None, went], 0)
        fits = np.array([[self.match[a] == self.match[b] for b in outs] for a in pool])
        if not fits.any():
            return None
        least = dist[fits].min()
        return min((int(least), int(self.group[a]), int(self.row[a]), int(self.row[b]))
                   for a, b in ((pool[i], outs[j]) for i, j in np.argwhere(fits & (dist == least))))

    def swap(self, group: int, donor: int, came: int, went: int) -> None:
        for at, old, new in ((self.at[came], donor, group), (self.at[went], group, donor)):
            self.members[old].discard(at)
            self.members[new].add(at)
            self.group[at] = new
            self.held[old, self.trait[at]] = self.count(old, self.trait[at]) - 1
            self.held[new, self.trait[at]] = self.count(new, self.trait[at]) + 1
        self.touched |= {group, donor}


def take_turns(due: pd.DataFrame, known: pd.DataFrame, by_gender: bool, strict_donor: bool, keeps: int, choices: int) -> pd.DataFrame:
    """The turns that can be decided, in order; a turn without a possible swap has no ids.

    ``known`` holds rows of two kinds: people, and list entries (donor, first person to come, distance) for
    those who want a trait in exchange for somebody of a profile.
    """
    cohort = Cohort(known[known["kind"] == "person"].reset_index(drop=True))
    lists: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)
    entries = known[known["kind"] == "entry"]
    for wanted, match, profile, dist, donor, came in zip(*(entries[c].tolist() for c in ("trait", "match", "profile_id", "dist", "group_id", "row_id"))):
        lists[wanted, match, profile].append((dist, donor, came))
    for own in lists.values():
        own.sort()
    # Every kind meets all donors of its match, so without any list for a match nobody can come.
    offered = {(wanted, match) for wanted, match, _ in lists}
    out = []
    for step in due.sort_values("turn").itertuples(index=False):
        group, wanted, given = int(step.flagged), step.wanted, step.given

        def may_go(trait: str, held: int) -> bool:
            return trait == given if by_gender else trait != wanted and (held > keeps or held == 1)

        def can_spare(donor: int) -> bool:
            held = cohort.count(donor, wanted)
            if by_gender:
                return held > keeps and (not strict_donor or cohort.count(donor, given) >= 1)
            return held > keeps or held == 1

        outs = cohort.leaving(group, may_go)
        best, unseen = cohort.nearest_touched(group, wanted, can_spare, outs) if outs else None, []
        missing = False
        for at in outs:
            kind = (wanted, cohort.match[at], cohort.profile[at])
            if kind not in lists and kind[:2] in offered:
                missing = True  # somebody of a rare kind who came here after the lists were made
                break
            own = lists.get(kind, [])
            valid = next((e for e in own if e[1] != group and e[1] not in cohort.touched), None)
            if valid:
                found = (*valid, int(cohort.row[at]))
                best = found if best is None else min(best, found)
            elif len(own) >= choices:
                unseen.append(own[-1])
        if missing or any(best is None or best[:3] > last for last in unseen):
            break  # the lists do not show enough
        if best:
            cohort.swap(group, best[1], best[2], best[3])
        dist, donor, came, went = best or (None, None, None, None)
        out.append((step.cohort_id, step.turn, group, step.isolation_type, came, donor, went, dist))
    return pd.DataFrame(out, columns=COLUMNS).astype({c: "Int64" for c in ("in_id", "donor_group", "out_id", "dist")})
