"""Operators for large training-data pipelines: text encoding, extraction, filtering, deduplication and packing."""
