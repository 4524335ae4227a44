"""Reproducible order and chance: MD5 of (seed, key), the same for any number of partitions and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int | str, key: Column | str) -> Column:
    """O1. Sort by this, then by the key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def uniform(seed: int | str, key: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits."""
    return F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
