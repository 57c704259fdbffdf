"""Bounded groups: split what would otherwise become one very large row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.cluster import checked_broadcast


def chunked(df: DataFrame, keys: Sequence[str], max_items: int, spread_by: Sequence[str]) -> DataFrame:
    """Add ``part``, so that a group of ``keys`` and ``part`` holds about ``max_items`` rows.

    Only groups over the limit are split, by hash of ``spread_by``. There is at
    most one such group per ``max_items`` rows, and their number is checked
    before they are broadcast.
    """
    large = (
        df.groupBy(*keys)
        .count()
        .where(F.col("count") > max_items)
        .select(*keys, F.ceil(F.col("count") / F.lit(max_items)).alias("_parts"))
    )
    slot = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_parts"), F.lit(1)))
    return df.join(checked_broadcast(large), list(keys), "left").withColumn("part", slot.cast("int")).drop("_parts")
