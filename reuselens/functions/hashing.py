"""Deterministic, partition-independent hashes that also exist in DuckDB,
so every sample and every bootstrap weight has an exact SQL oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, id_col: Column) -> Column:
    """md5(seed ':' id) as hex text: the sort key of every hash sample."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def hash_u32(text: Column) -> Column:
    """First 32 bits of md5(text) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
