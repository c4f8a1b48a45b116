"""Operators for training-data pipelines: deduplication, fingerprints, packing,
sharding, mixing, extraction, quality rules and language identification."""
