"""Seeded total order over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SEED = 42
BUCKET_DIGITS = 3  # 16**3 = 4096 buckets


def seeded_key(identifier: Column, seed: int = DEFAULT_SEED) -> Column:
    """A key that sorts identifiers in an order fixed by ``seed`` alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))


def key_bucket(key: Column, digits: int = BUCKET_DIGITS) -> Column:
    """The leading hex digits: even in size, and sorted like the key itself.

    Never null, so both uses of a bucketed input plan the same exchange and
    Spark runs it once.
    """
    return F.coalesce(F.substring(key, 1, digits), F.lit(""))


def with_seeded_key(
    df: DataFrame, identifier: str = "doc_id", seed: int = DEFAULT_SEED, digits: int = BUCKET_DIGITS
) -> DataFrame:
    keyed = df.withColumn("order_key", seeded_key(F.col(identifier), seed))
    return keyed.withColumn("bucket", key_bucket(F.col("order_key"), digits))
