"""Repeatable row assignment from the key: hold-out split and folds.

The assignment depends on the key only, never on file layout or partitioning, so a
lost task that runs again puts every row where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loofold.functions.scalars import quoted

# A linear congruential step modulo 2^31.
MODULUS = 2147483648
MULTIPLIER = 1103515245
INCREMENT = 12345


def key_bucket(key: Column, buckets: int, seed: int = 0) -> Column:
    """Bucket 0 .. buckets-1 of an integer key by two congruential steps.

    The high bits choose the bucket; all products stay within bigint.
    """
    modulus = F.lit(MODULUS).cast("bigint")
    step = F.pmod(key.cast("bigint") + F.lit(seed).cast("bigint"), modulus)
    for _ in range(2):
        step = F.pmod(step * F.lit(MULTIPLIER).cast("bigint") + F.lit(INCREMENT).cast("bigint"), modulus)
    return F.floor(step * F.lit(buckets).cast("bigint") / F.lit(float(MODULUS))).cast("int")


def fold_of(key: Column, k: int, seed: int = 0) -> Column:
    """Fold 0 .. k-1 of a key of any type."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int")


def holdout_split(
    df: DataFrame, key: str, test_fraction: float = 0.1, seed: int = 0
) -> DataFrame:
    """Adds ``is_test``; about ``test_fraction`` of the rows get true."""
    bucket = key_bucket(F.col(quoted(key)), 1000, seed)
    return df.withColumn("is_test", bucket < F.lit(round(test_fraction * 1000)))
