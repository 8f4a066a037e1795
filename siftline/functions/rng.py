"""Deterministic draws: a keyed hash instead of a sequential generator.

draw(seed, keys...) depends on nothing but its arguments, so that results do not
change with partitioning, retries or the cluster's size.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *keys) -> Column:
    """A number in [0, 1) from the seed and the keys: the first 32 bits of an MD5 over 2^32."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(k if isinstance(k, Column) else F.col(k)).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def index(seed: int, n: Column, *keys) -> Column:
    """A number in 0 .. n-1."""
    return F.floor(draw(seed, *keys) * n)


def sign(seed: int, *keys) -> Column:
    return F.when(draw(seed, *keys) < 0.5, F.lit(-1)).otherwise(F.lit(1))
