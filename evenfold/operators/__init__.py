"""Operators: each takes and returns DataFrames keyed by ``cohort_id``."""
