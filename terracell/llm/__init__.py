"""Operators of a training-data pipeline: filtering, deduplication, counting, packing and sharding of texts."""
