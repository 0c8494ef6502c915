"""Operators of a training-data pipeline: fingerprints, dedup, sharding, packing, tokens."""
