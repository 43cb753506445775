"""Sampling, splits and folds.

All of them are pure functions of the row key, so they give the same rows on
any partitioning and in DuckDB. Train and test are disjoint by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkselect.functions.hashing import SESSION_SEED, SPLIT_SEED, TWO_32, hash_bucket, md5_order
from sparkselect.functions.ranking import row_number_exact


def in_sample(key: str | Column, fraction: float, seed: int = SPLIT_SEED) -> Column:
    return hash_bucket(key, seed) < F.lit(float(fraction) * TWO_32)


def sample_fraction(df: DataFrame, key: str, fraction: float = 0.8, seed: int = SPLIT_SEED) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash of the key."""
    return df.where(in_sample(key, fraction, seed))


def sample_exact(df: DataFrame, key: str, fraction: float = 0.8, seed: int = SPLIT_SEED) -> DataFrame:
    """C1, exact-size form: the round(fraction n) rows with the smallest hash (ties by key)."""
    n = df.count()
    cut = int(fraction * n + 0.5)
    ranked = row_number_exact(df, [md5_order(key, seed), F.col(key)], name="__rn")
    return ranked.where(F.col("__rn") <= cut).drop("__rn")


def holdout(df: DataFrame, key: str, fraction: float = 0.8, seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test from one hash."""
    cond = in_sample(key, fraction, seed)
    return df.where(cond), df.where(~cond)


def holdout_column(df: DataFrame, key: str, fraction: float = 0.8, seed: int = SPLIT_SEED,
                   name: str = "split") -> DataFrame:
    """C2 as a label column: 'train' or 'test'."""
    return df.withColumn(name, F.when(in_sample(key, fraction, seed), "train").otherwise("test"))


def complement(df: DataFrame, train: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """C2 when a train table is given: rows of ``df`` whose key is not in it."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(train.select(*keys).distinct(), keys, "left_anti")


def tail_split(df: DataFrame, order_by: Sequence[str | Column], fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """First round(fraction n) rows in the stated (total) order, and the rest.

    Exact global positions come from sliced running counts, not from a
    single-partition window.
    """
    n = df.count()
    cut = int(fraction * n + 0.5)
    ranked = row_number_exact(df, order_by, name="__rn")
    return (ranked.where(F.col("__rn") <= cut).drop("__rn"),
            ranked.where(F.col("__rn") > cut).drop("__rn"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 10, seed: int = SESSION_SEED,
                     name: str = "fold") -> DataFrame:
    """C4: fold = (row_number over (partition by label order by md5(seed:key), key) - 1) mod k.

    Each class is dealt round-robin in hash order, so fold sizes per class
    differ by at most one. The numbering is exact and sliced, so a class with
    most of the rows is still spread over many tasks.
    """
    ranked = row_number_exact(df, [md5_order(key, seed), F.col(key)], partition_by=[label], name="__rn")
    return ranked.withColumn(name, ((F.col("__rn") - 1) % k).cast("bigint")).drop("__rn")
