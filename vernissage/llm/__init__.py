"""Operators of a training-data pipeline: deduplication, packing, tokens, search, scoring and scanning."""
