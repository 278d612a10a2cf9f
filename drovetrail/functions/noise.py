"""Reproducible noise: uniform numbers from a hash of a row's key, whatever the partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2**32


def draw(key: Column, seed: int, use: str) -> Column:
    """A whole number from 0 to 2**32 - 1 for a key, a seed and a use."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(seed)), F.lit(use))), 1, 8), 16, 10).cast("bigint")
