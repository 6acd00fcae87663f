"""Pipelines: from a people table to groups, scores and reports."""
