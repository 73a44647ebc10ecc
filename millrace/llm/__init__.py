"""Operators of a training-data pipeline: dedup, mixing, quality, packing, fingerprints."""
