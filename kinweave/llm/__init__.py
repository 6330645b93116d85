"""Operators for training-data pipelines: sharding, deduplication, scoring, mixing, tokenising, filtering, fingerprints."""
