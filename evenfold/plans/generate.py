"""Group generation: K-Medoids, equal sizes, nobody alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from evenfold.operators.locking import fix_gender_isolation
from evenfold.operators.medoids import MAX_SWAPS, kmedoids
from evenfold.operators.seeding import check_clusters, check_group_size, group_config, init_medoids
from evenfold.operators.sizing import enforce_group_size
from evenfold.plans.cohorts import Cohorts, label_people, prepare
from evenfold.plans.report import group_assignments

SEED = 42


@dataclass(frozen=True)
class Grouping:
    """Labelled people (0-based ``group_id``), the swaps made and the rows set aside."""

    labelled: DataFrame
    swap_log: DataFrame
    quarantine: DataFrame
    cohorts: Cohorts

    @property
    def assignments(self) -> DataFrame:
        return group_assignments(self.labelled)


def generate_groups(people: DataFrame, target_size: int, seed: int = SEED, max_iter: int = MAX_SWAPS,
                    max_passes: int = 1, max_rounds: int | None = None, strict_donor: bool = False,
                    fit_scope: str = "cohort", strict: bool = False) -> Grouping:
    """Split every cohort into similar groups of ``target_size`` without lone women or men."""
    size = check_group_size(target_size)
    cohorts = prepare(people, fit_scope=fit_scope, strict=strict)
    config = group_config(cohorts.people, size)
    check_clusters(config)
    slots = init_medoids(cohorts.people, cohorts.profiles, config, seed=seed)
    labels, _ = kmedoids(cohorts.profiles, slots, "manhattan", max_iter)
    sized = enforce_group_size(label_people(cohorts, labels), size, cohorts.profiles, "manhattan")
    fixed, log = fix_gender_isolation(sized.drop("label"), cohorts.profiles, max_passes, max_rounds, strict_donor)
    return Grouping(fixed, log, cohorts.quarantine, cohorts)
