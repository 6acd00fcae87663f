"""Operators of a training-data pipeline: joins, dedup, mixing, scoring, search, tokens, shards."""
