"""Operators of a training-data pipeline: deduplication, scoring, search, scanning, tokens and packing."""
