"""The shared first steps of every pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from evenfold.operators.joins import join_by_weight
from evenfold.operators.normalize import normalize_people
from evenfold.operators.profiles import SKILL_KEYS, attach_profiles, encode
from evenfold.operators.quality import split_usable
from evenfold.session import checkpoint
from evenfold.sources.people import read_people


@dataclass(frozen=True)
class Cohorts:
    """People with a ``profile_id``, and the profiles themselves."""

    people: DataFrame
    profiles: DataFrame
    quarantine: DataFrame
    keys: tuple[str, ...] = SKILL_KEYS


def clean(people: DataFrame) -> DataFrame:
    """Checked and cleaned people."""
    return normalize_people(read_people(people))


def prepare(people: DataFrame, keys: tuple[str, ...] = SKILL_KEYS, fit_scope: str = "cohort",
            strict: bool = False) -> Cohorts:
    """Clean people, set unusable rows aside, encode profiles and give people theirs.

    Profiles and people are written to the checkpoint folder: every later step starts there.
    """
    usable, quarantine = split_usable(clean(people), strict)
    profiles = encode(usable, keys, fit_scope)
    members = checkpoint(attach_profiles(usable, profiles, keys))
    return Cohorts(members, profiles, quarantine, keys)


def label_people(cohorts: Cohorts, labels: DataFrame) -> DataFrame:
    """People with the ``label`` of their profile."""
    weighted = labels.join(cohorts.profiles.select("cohort_id", "profile_id", "weight"), ["cohort_id", "profile_id"])
    small = weighted.withColumnRenamed("slot", "label")
    return join_by_weight(cohorts.people, small, ["cohort_id", "profile_id"], "weight").drop("weight")
