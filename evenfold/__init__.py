"""Balanced groups of similar people, for many cohorts at once, on Spark."""

from evenfold.operators.normalize import normalize_people
from evenfold.operators.quality import missing_values, validate_people
from evenfold.plans.balanced import form_balanced_groups
from evenfold.plans.compare import compare_metrics
from evenfold.plans.generate import generate_groups
from evenfold.plans.report import group_assignments, report_lines
from evenfold.plans.tournament import tournament
from evenfold.session import build_session
from evenfold.sources.people import read_people, read_people_csv
from evenfold.sources.sinks import write_assignments, write_comparison, write_report

__all__ = [
    "build_session", "compare_metrics", "form_balanced_groups", "generate_groups", "group_assignments",
    "missing_values", "normalize_people", "read_people", "read_people_csv", "report_lines", "tournament",
    "validate_people", "write_assignments", "write_comparison", "write_report",
]
