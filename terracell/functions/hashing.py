"""Sampling by plain integer arithmetic, so the same rows are chosen on every run and engine."""

from pyspark.sql import functions as F

MODULUS = 1000003


def sample_hash(key, seed=0):
    """0..MODULUS-1; meant for integer keys below about 3e9."""
    return (key.cast("long") * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(MODULUS)
