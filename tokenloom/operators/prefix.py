"""Running totals that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    *,
    group: Sequence[str] = (),
    bucket: str,
    order: Sequence[str],
    value: Column,
    name: str,
    stored: bool = False,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and including each row.

    ``bucket`` cuts each group into consecutive ranges of the order (all rows
    of a smaller bucket come before all rows of a larger one). Rows are summed
    inside their bucket; bucket totals, one row per bucket, give the offsets.
    ``value`` must not be negative.

    A narrow ``df`` is shuffled once for both uses. For a wide one pass a
    table on disk and ``stored=True``: totals then come from a second read of
    the few columns they need, and only partial sums move.
    """
    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_local", F.sum(value).over(inside))
    if stored:
        totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    else:
        totals = local.groupBy(*keys).agg(F.max("_local").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    return (
        local.join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_offset", "_local")
    )
