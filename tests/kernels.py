"""Round loops of one cohort as plain array code: expected values for the DataFrame rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.functions.measure import FAR, MICRO
from evenfold.operators.locking import DONOR_KEEPS, SwapRule
from evenfold.operators.medoids import signature
from evenfold.operators.ranking import rank_in_cohort


LABEL, CENTER = "label", "center"


def _differs(values: pd.Series) -> np.ndarray:
    codes = pd.factorize(values, use_na_sentinel=False)[0]
    return codes[:, None] != codes[None, :]


def _gap(values: pd.Series) -> np.ndarray:
    numbers = values.to_numpy()
    return np.abs(numbers[:, None] - numbers[None, :])


def distance_matrix(points: pd.DataFrame, metric: str) -> np.ndarray:
    """Distances of a cohort's profiles in micro units."""
    if metric == "manhattan":
        total = sum(_gap(points[c]) for c in ("q_motivation", "q_esteem", "q_ethic"))
        gaps = points["q_gap"].to_numpy()
        return total + np.where(_differs(points["Learning_Style"]), gaps[:, None] + gaps[None, :], 0)
    if metric == "euclidean":
        squares = sum(_gap(points[c]) ** 2 for c in ("z_motivation", "z_esteem", "z_ethic"))
        gaps = points["z_gap"].to_numpy() ** 2
        total = np.sqrt(squares + np.where(_differs(points["Learning_Style"]), gaps[:, None] + gaps[None, :], 0.0))
        return np.floor(total * MICRO + 0.5).astype(np.int64)
    total = np.zeros((len(points), len(points)))
    for score, span in (("Motivation", "span_motivation"), ("Self_Esteem", "span_esteem"), ("Work_Ethic", "span_ethic")):
        width = points[span].iloc[0]
        if width:
            total = total + _gap(points[score]) / width
    for category in ("Gender", "Diversity", "Learning_Style"):
        total = total + _differs(points[category])
    return np.floor(total / 6 * MICRO + 0.5).astype(np.int64)


def _nearest(matrix: np.ndarray, slots: np.ndarray, at: np.ndarray):
    """Lowest slot per distinct medoid, and n1 (as a position in it), d1, d2 per profile."""
    _, first, copies = np.unique(at, return_index=True, return_counts=True)
    order = np.argsort(first)
    owners, copies = first[order], copies[order]
    reach = matrix[:, at[owners]]
    rows = np.arange(len(matrix))
    n1 = reach.argmin(axis=1)
    d1 = reach[rows, n1]
    reach[rows, n1] = FAR
    d2 = np.where(copies[n1] > 1, d1, reach.min(axis=1))
    return owners, n1, d1, d2


def swap_rounds(points: pd.DataFrame, seats: pd.DataFrame, metric: str, max_iter: int) -> pd.DataFrame:
    """First-improvement swaps of one cohort until none improves or ``max_iter`` are made."""
    columns = ["cohort_id", "kind", "slot", "profile_id"]
    if points.empty or seats.empty:
        return pd.DataFrame(columns=columns)
    cohort = int(points["cohort_id"].iloc[0])
    points = points.sort_values("profile_id", ignore_index=True)
    seats = seats.sort_values("slot", ignore_index=True)
    ids = points["profile_id"].to_numpy()
    weight = points["weight"].to_numpy()[:, None]
    matrix = distance_matrix(points, metric)
    slots = seats["slot"].to_numpy()
    at = np.searchsorted(ids, seats["profile_id"].to_numpy())
    for _ in range(max_iter):
        owners, n1, d1, d2 = _nearest(matrix, slots, at)
        if float(weight.sum()) * float(max(d1.max(), np.minimum(d2, matrix.max()).max())) > 9e18:
            raise OverflowError(f"distances of cohort {cohort} leave 64 bits")
        closer = np.minimum(matrix, d1[:, None])
        gain = (weight * (closer - d1[:, None])).sum(axis=0)
        loss = weight * (np.minimum(matrix, d2[:, None]) - closer)
        by_owner = np.argsort(n1, kind="stable")
        used, starts = np.unique(n1[by_owner], return_index=True)
        better = gain + np.add.reduceat(loss[by_owner], starts, axis=0) < 0
        found = []
        improving = np.flatnonzero(better.any(axis=1))
        if len(improving):
            found.append((owners[used[improving[0]]], better[improving[0]].argmax()))
        spare = np.setdiff1d(np.arange(len(slots)), owners)
        if len(spare) and (gain < 0).any():
            found.append((spare[0], (gain < 0).argmax()))
        if not found:
            break
        seat, candidate = min(found)
        at[seat] = candidate
    owners, n1, _, _ = _nearest(matrix, slots, at)
    labels = pd.DataFrame({"kind": LABEL, "slot": slots[owners[n1]], "profile_id": ids})
    centers = pd.DataFrame({"kind": CENTER, "slot": slots, "profile_id": ids[at]})
    return pd.concat([labels, centers]).assign(cohort_id=cohort)[columns]


def mean_rounds(points: pd.DataFrame, seats: pd.DataFrame, metric: str, max_iter: int) -> pd.DataFrame:
    """Assignment and mean update of one cohort until no centroid moves."""
    columns = ["cohort_id", "kind", "slot", "profile_id", "centroid"]
    if points.empty or seats.empty:
        return pd.DataFrame(columns=columns)
    cohort = int(points["cohort_id"].iloc[0])
    points = points.sort_values("profile_id", ignore_index=True)
    seats = seats.sort_values("slot", ignore_index=True)
    ids, weight = points["profile_id"].to_numpy(), points["weight"].to_numpy()
    vectors = np.stack(points["features_q"].to_numpy())
    slots = seats["slot"].to_numpy()
    centers = vectors[np.searchsorted(ids, seats["profile_id"].to_numpy())]

    def nearest(centers: np.ndarray) -> np.ndarray:
        # np.unique keeps the first, hence lowest, slot of equal centroids.
        first = np.sort(np.unique(centers, axis=0, return_index=True)[1])
        reach = 0
        for column in range(vectors.shape[1]):
            gap = vectors[:, column, None] - centers[None, first, column]
            reach = reach + (np.abs(gap) if metric == "manhattan" else gap.astype(float) ** 2)
        return first[reach.argmin(axis=1)]

    before = centers
    for _ in range(max_iter):
        before, owner = centers, nearest(centers)
        sums = np.zeros(centers.shape, dtype=np.int64)
        people = np.zeros(len(slots), dtype=np.int64)
        np.add.at(sums, owner, weight[:, None] * vectors)
        np.add.at(people, owner, weight)
        means = sums / np.maximum(people, 1)[:, None]
        rounded = np.trunc(means + np.copysign(0.5, means)).astype(np.int64)
        centers = np.where(people[:, None] > 0, rounded, before)
        if (centers == before).all():
            break
    labels = pd.DataFrame({"kind": LABEL, "slot": slots[nearest(before)], "profile_id": ids, "centroid": None})
    finals = pd.DataFrame({"kind": CENTER, "slot": slots, "profile_id": None, "centroid": list(centers)})
    return pd.concat([labels, finals]).assign(cohort_id=cohort).astype({"profile_id": "Int64"})[columns]


def sequential_swaps(people: pd.DataFrame, flagged: pd.DataFrame, by_gender: bool, strict_donor: bool,
                     donor_keeps: int, max_rounds: int | None, first_round: int) -> pd.DataFrame:
    """The swaps of one cohort's flagged groups, each on the labels the one before left."""
    columns = ["cohort_id", "round", "group_id", "isolation_type", "in_id", "donor_group", "out_id", "dist"]
    if people.empty or flagged.empty:
        return pd.DataFrame(columns=columns)
    people = people.sort_values("row_id", ignore_index=True)
    flagged = flagged.sort_values("turn").head(max_rounds if max_rounds is not None else len(flagged))
    ids, group = people["row_id"].to_numpy(), people["group_id"].to_numpy().copy()
    trait, match = people["trait"].to_numpy(), people["match"].to_numpy()
    style, gap = people["Learning_Style"].to_numpy(), people["q_gap"].to_numpy()
    place = people[["q_motivation", "q_esteem", "q_ethic"]].to_numpy()
    # People of one profile tie in every distance, so the first of each stands for them.
    alike = pd.factorize(people["profile_id"].astype(str) + "/" + people["match"].astype(str))[0]
    log = []
    for step in flagged.itertuples(index=False):
        wanted = trait == step.wanted
        width = int(group.max()) + 1
        held = np.bincount(group[wanted], minlength=width)
        spare = held > donor_keeps
        inside = group == step.group_id
        if by_gender:
            leaving = inside & (trait == step.given)
            if strict_donor:
                spare &= np.bincount(group[trait == step.given], minlength=width) >= 1
        else:
            spare |= held == 1
            kinds, at, counts = np.unique(trait[inside].astype(str), return_inverse=True, return_counts=True)
            own = np.zeros(len(group), dtype=np.int64)
            own[inside] = counts[at]
            leaving = inside & ~wanted & pd.notna(trait) & ((own > donor_keeps) | (own == 1))
        spare[step.group_id] = False
        comers, goers = np.flatnonzero(wanted & spare[group]), np.flatnonzero(leaving)
        if not len(comers) or not len(goers):
            continue
        comers = comers[np.argsort(group[comers], kind="stable")]
        comers = comers[np.unique(alike[comers], return_index=True)[1]]
        goers = goers[np.unique(alike[goers], return_index=True)[1]]
        dist = np.abs(place[comers, None, :] - place[None, goers, :]).sum(axis=2)
        dist = dist + np.where(style[comers, None] != style[None, goers], gap[comers, None] + gap[None, goers], 0)
        if not by_gender:
            dist = np.where(match[comers, None] == match[None, goers], dist, FAR)
        best = dist.min()
        if best == FAR:
            continue
        # Equal distances: lowest donor group, then incoming row, then outgoing row.
        ties = np.argwhere(dist == best)
        came, went = min(((comers[i], goers[j]) for i, j in ties), key=lambda p: (group[p[0]], p[0], p[1]))
        donor = int(group[came])
        log.append((first_round - 1 + step.turn, step.group_id, step.isolation_type, ids[came], donor, ids[went], best))
        group[came], group[went] = step.group_id, donor
    out = pd.DataFrame(log, columns=columns[1:])
    out.insert(0, "cohort_id", int(people["cohort_id"].iloc[0]))
    return out


def _by_cohort(first: DataFrame, second: DataFrame, solve) -> pd.DataFrame:
    left, right = first.toPandas(), second.toPandas()
    found = [solve(part, right[right.cohort_id == c].reset_index(drop=True))
             for c, part in left.reset_index(drop=True).groupby("cohort_id") if (right.cohort_id == c).any()]
    return pd.concat(found) if found else pd.DataFrame()


def plain_kmeans(profiles: DataFrame, slots: DataFrame, metric: str, max_iter: int) -> pd.DataFrame:
    points = profiles.select("cohort_id", "profile_id", "weight", "features_q").orderBy("cohort_id", "profile_id")
    return _by_cohort(points, slots, lambda p, s: mean_rounds(p.reset_index(drop=True), s, metric, max_iter))


def plain_kmedoids(profiles: DataFrame, slots: DataFrame, metric: str, max_iter: int) -> pd.DataFrame:
    points = signature(profiles, metric).orderBy("cohort_id", "profile_id")
    return _by_cohort(points, slots, lambda p, s: swap_rounds(p.reset_index(drop=True), s, metric, max_iter))


def plain_swaps(labelled: DataFrame, profiles: DataFrame, rule: SwapRule, turns: int) -> list[tuple]:
    match = F.coalesce(F.col(rule.match), F.lit("")) if rule.match else F.lit("")
    people = labelled.select(
        "cohort_id", "row_id", "group_id", "profile_id", F.col(rule.attribute).alias("trait"), match.alias("match"),
    ).join(profiles.select("cohort_id", "profile_id", "Learning_Style", "q_motivation", "q_esteem", "q_ethic", "q_gap"),
           ["cohort_id", "profile_id"])
    flagged = rank_in_cohort(rule.flag(labelled), ["group_id", "wanted"], "turn")
    found = _by_cohort(people, flagged, lambda p, d: sequential_swaps(
        p.reset_index(drop=True), d, rule.attribute == "Gender", rule.strict_donor, DONOR_KEEPS, turns, 1))
    return [tuple(r) for r in found.itertuples(index=False)]
