"""Operators of a training-data pipeline: packing, scoring, deduplication, counting, mixing, scanning and search."""
