"""Deterministic hashes of keys.

Row sets chosen by ``df.sample`` change with the partitioning, so every split,
fold, bootstrap weight and random draw here is a pure function of the row key
and a seed. The same text runs in DuckDB, which keeps every split checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seeds of the reference run (split 786, session 123).
SPLIT_SEED = 786
SESSION_SEED = 123
TWO_32 = 4294967296


def _keystr(key: Column | str, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{seed}:"), k.cast("string"))


def md5_order(key: Column | str, seed: int = SESSION_SEED) -> Column:
    """md5 text of ``seed:key``; a random but repeatable sort key."""
    return F.md5(_keystr(key, seed))


def hash_bucket(key: Column | str, seed: int = SPLIT_SEED) -> Column:
    """Integer in 0 .. 2^32-1 from the first 8 hex digits of md5(seed:key)."""
    return F.conv(F.substring(F.md5(_keystr(key, seed)), 1, 8), 16, 10).cast("bigint")


def hash_unit(key: Column | str, seed: int = SPLIT_SEED) -> Column:
    """hash_bucket scaled to [0, 1)."""
    return hash_bucket(key, seed) / F.lit(float(TWO_32))


def hash_small(key: Column | str, seed: int, digits: int = 2) -> Column:
    """Integer from the first ``digits`` hex digits of md5(seed:key)."""
    return F.conv(F.substring(F.md5(_keystr(key, seed)), 1, digits), 16, 10).cast("bigint")

